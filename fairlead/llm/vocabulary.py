"""Pieces and scores of an existing SentencePiece model file."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """``pieces[i]`` and ``scores[i]`` belong to ``ids[i]``; ``byte_ids[b]`` is the fallback piece of byte b."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]
    byte_scores: tuple[float, ...]

    def log_shares(self) -> np.ndarray:
        """Natural-log shares of pieces (in their order), the 256 bytes and the end, in all one, for models whose scores only rank.

        The r-th best score gets a share in proportion to 1 / (r + 3), as words by frequency do; bytes and end get the last.
        """
        ranks = np.argsort(np.argsort(-np.array(self.scores), kind="stable"), kind="stable")
        shares = 1 / (np.append(ranks, np.full(257, len(ranks))) + 3)
        return np.log(shares / shares.sum())

    def with_log_shares(self) -> Vocabulary:
        """The same pieces with ``log_shares`` as scores."""
        logs = self.log_shares().tolist()
        n = len(self.pieces)
        return replace(self, scores=tuple(logs[:n]), byte_scores=tuple(logs[n:-1]))


def read_vocabulary(path: str) -> Vocabulary:
    """Ordinary and byte pieces of a model file; control, unknown and unused pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, ids, of_byte = [], [], [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            of_byte[int(model.id_to_piece(i)[3:5], 16)] = (i, model.get_score(i))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append(model.id_to_piece(i))
            scores.append(model.get_score(i))
            ids.append(i)
    fallback = [of_byte[b] for b in range(256)] if len(of_byte) == 256 else []
    return Vocabulary(tuple(pieces), tuple(scores), tuple(ids), tuple(x[0] for x in fallback), tuple(x[1] for x in fallback))
