"""Token counts with a whole-token shortcut.

Offline, once per task, every vocabulary string is encoded alone: those that come back as exactly one
token form the shortcut set. A text is cut before each space run; no vocabulary string holds a space
after another character (checked on loading), so no merge crosses such a cut and the counts of the
parts add up to the count of the text. Parts in the shortcut set count 1 without any merging; only
the rest go through the library's merges, each distinct part once in a bounded memo.

Cases: null and empty texts have no tokens; long texts are cut the same way, nothing is truncated;
parts that the cut does not cover (a space at the very start) go to the library as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import sets_aside, text_or_empty

#: Distinct merged parts kept per task; when full, the memo starts anew.
MEMO = 600_000


class PieceCounter:
    """Counts SentencePiece tokens of texts; holds the model, the shortcut set and the memo."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))]
        # The proof that cuts before space runs are safe for this vocabulary.
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.lib.encode("a b")) == len(self.lib.encode("a")) + len(self.lib.encode("b"))
        starts = [p[1:] for p in pieces if p[:1] == "▁" and p[1:2] not in ("", "▁")]
        self.whole = {s for s, ids in zip(starts, self.lib.encode(starts, num_threads=1)) if len(ids) == 1}
        self.memo: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        """The text's parts without the one space that the library puts before each of them."""
        if "▁" in text or "\0" in text:
            return [text]
        if "  " not in text and text[-1:] != " " and text[:1] != " ":
            return text.split(" ")
        # A run of k spaces belongs to the part after it; the last run may have none.
        found = re.findall(r" *[^ ]+| +$", text)
        return [p[1:] if k and p[0] == " " else p for k, p in enumerate(found)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(ids) for ids in self.lib.encode(texts, num_threads=1)]
        tallies = [Counter(self.parts(t)) if t else Counter() for t in texts]
        seen = set().union(*tallies) if tallies else set()
        rest = list(seen - self.whole - self.memo.keys())
        if len(self.memo) + len(rest) > MEMO:
            self.memo = {}
            rest = list(seen - self.whole)
        # A lone empty part stands for the space before it: the library drops it, so it is spelt out.
        self.memo.update(zip(rest, map(len, self.lib.encode(rest, num_threads=1))))
        if "" in seen:
            self.memo[""] = 1
        whole, memo = self.whole, self.memo
        return [sum(n if p in whole else n * memo[p] for p, n in tally.items()) for tally in tallies]


@sets_aside
def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096, out: tuple[str, str] = ("n_tokens", "over_limit")) -> DataFrame:
    """``docs`` with the token count of each whole text and whether it is over ``limit``.

    One narrow pass with no shuffle: the text goes to Python once and only its count comes back.
    """
    state: dict[str, PieceCounter] = {}

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = state.setdefault(model, PieceCounter(model)) if model not in state else state[model]
        for batch in batches:
            yield pd.Series(counter.count(batch.tolist()), dtype="int64")

    keep = [c for c in docs.columns if c not in out]
    return docs.select(*(F.col(f"`{c}`") for c in keep), tokens(text_or_empty(text)).alias(out[0])).withColumn(out[1], F.col(out[0]) > limit)
