"""A subword vocabulary read as a unigram model: pieces with log scores.

The public vocabulary files hold no unigram model, so the pieces and the order
of piece_bpe_32k.model are taken as they are and each piece gets the Zipf
log-probability of its rank, -ln(rank + 2) less the log of their sum, rounded to
a multiple of 1/1024. Sums of such scores are exact in doubles, so ties are ties
in any order of addition. Control pieces never match text; a character that no
piece covers is as many byte pieces as it has UTF-8 bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import ahocorasick

DEFAULT_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_GRID = 1024


@dataclass
class Vocabulary:
    """Pieces and their scores, without control and byte pieces."""

    pieces: list[str]
    scores: list[float]
    _automaton: object = field(default=None, repr=False, compare=False)

    @property
    def unknown(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY

    def automaton(self):
        """Aho-Corasick automaton of the pieces; its values are (length, id)."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                self._automaton.add_word(p, (len(p), i))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "_automaton": None}


def zipf(ranks: list[int]) -> list[float]:
    total = math.log(sum(1 / (r + 2) for r in ranks)) if ranks else 0.0
    return [round((-math.log(r + 2) - total) * _GRID) / _GRID for r in ranks]


def load_vocabulary(path: str = DEFAULT_PATH) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary([sp.id_to_piece(i) for i in ids], _by_rank(sp, ids))


def _by_rank(sp, ids: list[int]) -> list[float]:
    """The file scores a piece by minus its rank."""
    order = sorted(range(len(ids)), key=lambda k: -sp.get_score(ids[k]))
    scores = zipf(list(range(len(ids))))
    out = [0.0] * len(ids)
    for rank, k in enumerate(order):
        out[k] = scores[rank]
    return out
