"""Token counts by an exact length histogram.

Every whole text is encoded with a public byte-level BPE vocabulary; documents are counted by
their exact number of tokens. Suffix sums over that histogram answer totals, quantiles and the
tokens that a context limit would keep, for every limit, without going back to the texts.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such vocabularies split a text before they merge bytes (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space (as the pattern means it) from this length on are cut out, as the pattern's matcher has no bound on what it holds of one.
LONG_SPACE = 1 << 12
_long_space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
#: Lengths that one task of the suffix sums gets.
SPAN = 256

_encoders: dict = {}


def encoder(name: str, raw: bytes):
    """One encoder a process."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _encoders[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def n_tokens(enc, text: str | None) -> int:
    """How many tokens the whole text has.

    A long run of white space is a piece of its own: all of it at the end of a text, else all but its
    last character, which may belong to the next word. What is before and behind is cut as ever.
    """
    if not text:
        return 0
    n, at = 0, 0
    for m in _long_space.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns of `keep` and n_tokens of each row of docs (text).

    Null and empty texts have 0; special tokens' strings are ordinary text. Texts, words and runs of
    white space may have any length. Repeated rows count as
    often as they come; no rows give no rows. Other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size, read once by the driver

    def count(texts):
        enc = encoder(vocabulary, shared.value)
        return [[n_tokens(enc, t) for t in texts]]

    return mapped(docs, keep, ["text"], {"n_tokens": "long"}, count)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs, and for each length that occurs: documents and tokens at or above it, tokens of all, tokens kept by a limit of that length, share of documents at or below it.

    One row a distinct length. An empty table has no row. A limit between two lengths keeps what
    limit_total() says.
    """
    h = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths").withColumn("span", F.floor(F.col("n_tokens") / SPAN))  # texts are encoded once
    spans = h.groupBy("span").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # one row for SPAN lengths
    spans = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    here = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    total = h.agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).first()
    docs_all, tokens_all = (F.lit(total[n] or 0).cast("long") for n in ("docs", "tokens"))
    out = h.join(spans, "span").withColumn("docs_from", F.sum("docs").over(here) + F.col("d_above")).withColumn("tokens_from", F.sum(F.col("docs") * F.col("n_tokens")).over(here) + F.col("t_above"))
    out = out.withColumns({"docs_all": docs_all, "tokens_all": tokens_all})
    return out.select(
        "n_tokens", "docs", "docs_from", "tokens_from", "docs_all", "tokens_all",
        (F.col("tokens_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("kept_at_limit"),
        ((F.col("docs_all") - F.col("docs_from") + F.col("docs")) / F.col("docs_all")).alias("share_upto"))


def limit_total(suffix: DataFrame, limit: int) -> DataFrame:
    """Tokens that truncation to `limit` keeps: one row, kept."""
    long = F.col("n_tokens") >= limit
    total, docs, rest = F.max("tokens_all"), F.max(F.when(long, F.col("docs_from"))), F.max(F.when(long, F.col("tokens_from")))
    return suffix.agg((F.coalesce(total, F.lit(0)) - F.coalesce(rest, F.lit(0)) + F.coalesce(docs, F.lit(0)) * limit).alias("kept"))


def quantile(suffix: DataFrame, q: float) -> DataFrame:
    """The smallest length with a share of at least q at or below it: one row, n_tokens (null for no documents)."""
    return suffix.where(F.col("share_upto") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return histogram(counted(table(spark, sf_dir, "documents")))
