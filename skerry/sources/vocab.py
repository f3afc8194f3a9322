"""Vocabulary files and WordPiece encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocab(spark: SparkSession, path: str, lenient: bool = True) -> dict[str, int]:
    """Line -> index. ``lenient`` trims lines and gives an empty vocabulary if the file can't be read."""
    try:
        lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    except Exception:
        if lenient:
            return {}
        raise
    rows = "".join(lines).split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    return {(r.strip() if lenient else r.rstrip("\r")): i for i, r in enumerate(rows)}


def vocab_map(vocab: dict[str, int]) -> Column:
    """A vocabulary as a map column, for small vocabularies."""
    return F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])


def _pieces(word: str, vocab: dict[str, int]) -> list[int]:
    unk, ids, at = vocab.get("[UNK]", 100), [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        ids.append(unk if end is None else vocab[("##" if at else "") + word[at:end]])
        at = at + 1 if end is None else end
    return ids


def wordpiece(text: str, vocab: dict[str, int], max_len: int = 128) -> tuple[list[int], list[int]]:
    """Ids and mask: [CLS], the longest known piece at each place (## within words), [SEP], padded.

    An unknown character is [UNK]. No word is begun once max_len - 1 ids are there, but
    a word's pieces may run over the end, which cuts [SEP] off.
    """
    ids = [vocab.get("[CLS]", 101)]
    for word in (text or "").lower().split():
        if len(ids) >= max_len - 1:
            break
        ids += _pieces(word, vocab)
    ids = (ids + [vocab.get("[SEP]", 102)])[:max_len]
    return ids + [0] * (max_len - len(ids)), [1] * len(ids) + [0] * (max_len - len(ids))


def wordpiece_windows(text: str, vocab: dict[str, int], max_len: int = 128) -> list[tuple[list[int], list[int]]]:
    """All of a text: windows of [CLS], up to max_len - 2 pieces, [SEP] and padding, each with its mask."""
    ids = [i for word in (text or "").lower().split() for i in _pieces(word, vocab)]
    step, out = max_len - 2, []
    for at in range(0, max(len(ids), 1), step):
        part = [vocab.get("[CLS]", 101), *ids[at : at + step], vocab.get("[SEP]", 102)]
        out.append((part + [0] * (max_len - len(part)), [1] * len(part) + [0] * (max_len - len(part))))
    return out


def encode_wordpiece_windows(df: DataFrame, vocab: dict[str, int], text_col: str = "text", max_len: int = 128) -> DataFrame:
    """``df`` with a row for each window of a text: columns window, from 0, and encoded (input_ids, attention_mask)."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("array<struct<input_ids: array<int>, attention_mask: array<int>>>")
    def enc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"input_ids": i, "attention_mask": m} for i, m in wordpiece_windows(t, sent.value, max_len)])

    return df.select("*", F.posexplode(enc(F.col(text_col))).alias("window", "encoded"))


def encode_wordpiece(df: DataFrame, vocab: dict[str, int], text_col: str = "text", max_len: int = 128) -> DataFrame:
    """``df`` with a struct column encoded (input_ids, attention_mask); the vocabulary is broadcast once."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>")
    def enc(texts):
        import pandas as pd

        pairs = [wordpiece(t, sent.value, max_len) for t in texts]
        return pd.DataFrame({"input_ids": [p[0] for p in pairs], "attention_mask": [p[1] for p in pairs]})

    return df.withColumn("encoded", enc(F.col(text_col)))
