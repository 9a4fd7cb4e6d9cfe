"""Token counts through a digest cache, and the token ids that packing needs.

Both tokenizers cut a text into segments that never share a token, so a worker
keeps a bounded memo of segments and asks the library for the others:

* the sentencepiece model has no piece with a word mark behind another
  character, so a run of spaces and what follows up to the next space is one
  segment;
* the byte-level model's own pattern cuts the text into pieces.

Texts that leave the ground on which the cut is proved (see ``_plain``) go to
the library whole. The memo tells segments apart by their bytes.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import vectext as V
from millrace.llm.common import shared_dir, stage

_state: dict = {}


# --- sentencepiece ---------------------------------------------------------

def _sentencepiece(path: str):
    if ("sp", path) not in _state:
        import sentencepiece

        _state["sp", path] = (sentencepiece.SentencePieceProcessor(model_file=path), V.Memo(21))
    return _state["sp", path]


def sentencepiece_counts(docs: list[bytes], path: str) -> np.ndarray:
    """Number of tokens of each UTF-8 text, as the library gives it."""
    sp, memo = _sentencepiece(path)
    out = np.zeros(len(docs), dtype=np.int64)
    # the model's word mark inside a text counts as a space
    odd = [i for i, d in enumerate(docs) if b"\xe2\x96\x81" in d]
    for i in odd:
        out[i] = len(sp.encode(docs[i].decode()))
    skip = set(odd)
    rows = [i for i, d in enumerate(docs) if d and i not in skip]
    plain = [docs[i] for i in rows]
    for lo, hi in V.slices(plain):
        part = plain[lo:hi]
        joined = b" " + b" ".join(part)
        buf = np.frombuffer(joined, dtype=np.uint8)
        at = np.cumsum([0] + [len(d) + 1 for d in part])
        blank = buf == 32
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[at[:-1]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(buf))

        def count(segments):
            # the library puts one word mark before each text itself
            return [max(1, len(x)) for x in sp.encode([x[1:].decode() for x in segments], num_threads=1)]

        sizes = memo.sizes(joined, start, end, count)
        first = np.searchsorted(start, at[:-1])
        out[rows[lo:hi]] = np.add.reduceat(sizes, first)
    return out


def count_tokens(docs: DataFrame, model: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Token counts of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a Parquet table (digest binary, tokenizer string, n_tokens
    long) in storage that all executors share; by default a new one in the
    shared folder. Contents are joined to it by SHA-256 digest and by the
    digest of the model file; only distinct misses are encoded, then appended.
    The text is the normalised content: this model's own normaliser is the
    identity. A null text counts as empty, an empty text has 0 tokens;
    repeated rows are encoded once and each gets its count; null doc_ids stay;
    other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    import hashlib

    with open(model, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    cache = cache or f"{shared_dir(spark)}/millrace/token-cache-{version[:12]}-{spark.sparkContext.applicationId}-{id(docs):x}"
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    body = body.withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = stage(body.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    schema = "digest binary, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    held = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)

    key = F.coalesce("doc_id", F.lit(-(2**63)))
    misses = known.groupBy("digest").agg(F.min(key).alias("row")).join(held, "digest", "left_anti")
    wanted = body.withColumn("row", key).join(misses.hint("shuffle_hash"), ["digest", "row"]).select("digest", "text")

    def encode(batches):
        for b in batches:
            for lo, hi, bodies in V.parts(b.column(1)):
                got = sentencepiece_counts(bodies, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(got)], ["digest", "n_tokens"])

    new = wanted.mapInArrow(encode, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stage(counts, "counts")  # so that a join on a digest of very many rows can be split
    return known.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


# --- byte-level BPE --------------------------------------------------------

def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space for the code points below U+0280."""
    out = np.full(0x280, 2, dtype=np.uint8)
    for cp in range(0x280):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            out[cp] = "LN".index(kind)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 3
    return out


CLASS = _classes()
CLASS1 = np.concatenate([CLASS[:128], np.full(128, 2, dtype=np.uint8)])
SPECIAL = b"<|endoftext|>"


def _plain(doc: bytes) -> bool:
    """Only code points below U+0280, whose classes every Unicode version shares, and no special string."""
    return not doc.translate(None, _BELOW) and SPECIAL not in doc


_BELOW = bytes([*range(0xCA)])


def piece_starts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's pieces begin; ``at`` has the texts' starts and the end."""
    kind = CLASS1[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    if len(lead):
        cp = ((buf[lead].astype(np.int32) & 31) << 6) | (buf[lead + 1] & 63)
        kind[lead] = kind[lead + 1] = CLASS[cp]
    n = len(buf)
    begin = np.zeros(n + 1, dtype=bool)
    begin[1:n] = kind[1:] != kind[:-1]
    begin[at] = True
    head = np.zeros(n + 1, dtype=bool)
    head[at] = True
    # the last white-space character of a run before other text stands alone or, if a space, joins that text
    after = np.flatnonzero(begin[1:n] & (kind[1:] != 3) & (kind[:-1] == 3) & ~head[1:n]) + 1
    last = np.where(buf[after - 1] < 0x80, after - 1, after - 2)
    begin[last] = True
    begin[after[buf[after - 1] == 32]] = False
    # contractions: an apostrophe that begins a piece and stands alone
    mark = np.flatnonzero((buf == 39) & begin[:n])
    if len(mark):
        pad = np.concatenate([buf, np.zeros(3, dtype=np.uint8)])
        stop = np.append(at, n)
        room = stop[np.searchsorted(at, mark, side="right")] - mark
        a, b = pad[mark + 1], pad[mark + 2]
        one = (room > 1) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (room > 2) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        begin[mark[one | two] + 1] = False
        begin[mark[one] + 2] = True
        begin[mark[two] + 3] = True
    return np.flatnonzero(begin[:n])


def _bpe(path: str):
    if ("bpe", path) not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        _state["bpe", path] = (whole, _single_piece(whole), V.Memo(20))
    return _state["bpe", path]


def _single_piece(whole):
    """The merges for one piece. The ids of this vocabulary follow the order of
    its merges, so they serve as the ranks of tiktoken's merge loop, which has
    less to do for each call than the tokenizer's own."""
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {bytes(byte[c] for c in word): i for word, i in whole.get_vocab(with_added_tokens=False).items() if word != SPECIAL.decode()}
    return tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def byte_bpe_ids(docs: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of each UTF-8 text as the library gives them, without added special tokens."""
    tokenizer, single, memo = _bpe(path)
    out: list = [None] * len(docs)
    rows = []
    for i, d in enumerate(docs):
        if not d:
            out[i] = np.zeros(0, dtype=np.int32)
        elif _plain(d):
            rows.append(i)
        else:
            out[i] = np.array(tokenizer.encode(d.decode(), add_special_tokens=False).ids, dtype=np.int32)
    plain = [docs[i] for i in rows]
    for lo, hi in V.slices(plain):
        part = plain[lo:hi]
        joined = b"".join(part)
        buf = np.frombuffer(joined, dtype=np.uint8)
        at = np.cumsum([0] + [len(d) for d in part])
        start = piece_starts(buf, at)
        end = np.append(start[1:], len(buf))
        size, ids = memo.ids(joined, start, end, lambda segments: [single(x) for x in segments])
        edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, at[1:-1])].astype(np.int64)
        for i, one in zip(rows[lo:hi], np.split(ids, edge)):
            out[i] = one
    return out
