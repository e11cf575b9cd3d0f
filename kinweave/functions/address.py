"""Words of postal addresses."""

from __future__ import annotations

# Numbers in words.
NUMBER_WORDS = "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN TWENTY"

NUMBER_OF = {w: str(i) for i, w in enumerate(NUMBER_WORDS.split(), 1)}
