"""Token counts of whole texts; only lengths leave the Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import encoder
from strata.llm.texts import map_texts

LIMIT = 512


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """`docs` without its text, with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    Texts are encoded in Arrow batches that are cut to slices of about equal bytes; long texts are cut where the
    vocabulary cannot join, so the counts equal those of the whole text. No begin, end or padding tokens. Special
    strings in a text count as the library counts them. A null text counts as the empty one: 0 bytes, 0 tokens.
    Nothing is shuffled, and repeated rows stay.
    """
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    counted = map_texts(sized, text, "n_tokens long", lambda: lambda texts: [encoder(vocabulary).counts(texts)], drop_text=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
