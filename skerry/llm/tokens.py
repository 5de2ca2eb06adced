"""Sizes of texts in tokens of a public tokenizer, whose model file is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A unit: a line end with the word after it, spaces with the word after them, or the word that a text begins with.
UNIT = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")
BLANK = "▁"  # how the vocabulary writes a space (fixed value)
REMEMBERED = 500_000  # units whose counts a task keeps
LONG = 100  # characters of a unit that is not kept


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(sp) -> bool:
    """Whether units can be counted one by one: no piece goes on over a space or line end, and a text is encoded as it stands after one blank.

    Then merging never joins two units, so a text's tokens are those of its units.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces) and "".join(sp.encode("  a  b ", out_type=str)) == "   a  b ".replace(" ", BLANK)


def counter(model: bytes) -> Callable[[str], int]:
    """The number of tokens of a text, exactly as encoding it whole gives it.

    Texts repeat their words, so the counts of units are remembered, at most ``REMEMBERED`` at a
    time, which changes the work only. A model whose units can't be told apart encodes texts whole.
    """
    sp = processor(model)
    if not separable(sp):
        return lambda text: len(sp.encode(text))
    known: dict[str, int] = {" ": 1}

    def count(text: str) -> int:
        if BLANK in text:  # which would merge with spaces
            return len(sp.encode(text))
        units = UNIT.findall(text)
        if not units:
            return 0
        new = [u for u in set(units).difference(known)]
        # A blank is put before what is encoded: it stands for a unit's first space, and is taken off from a line end.
        for u, ids in zip(new, sp.encode([u[1:] if u[0] == " " else u for u in new], num_threads=1)):
            known[u] = len(ids) - (u[0] == "\n")
        first = units[0]
        n = sum(map(known.__getitem__, units)) - known[first] + len(sp.encode(first))
        if len(known) > REMEMBERED:
            known.clear()
            known[" "] = 1
        else:
            for u in new:
                if len(u) > LONG:
                    del known[u]
        return n

    return count


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of ``text``, 0 for null and empty text. The model's bytes go to the executors with the function."""
    with open(vocabulary, "rb") as f:
        model = f.read()

    @F.pandas_udf("int")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model)
        for b in batches:
            yield pd.Series([count(t) if t else 0 for t in b], dtype="int32")

    return counts(text)
