"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece whose length lies in (capacity / (k + 1), capacity / k] belongs to class k, and a sequence of class k holds
exactly k pieces. A document gives as many full pieces as it has; the rest is cut so that each piece fills its class to
at least FILL. Workers number the pieces of each class on their own; one small table of counts by task and class then
gives each task its first number, and number // k is the sequence. Fewer than k pieces of each class stay over, at most
some 9,000 in all for a capacity of 2,048 whatever the input; these are packed first-fit decreasing by one task.

Null or empty text: a document of the end id alone. Very long texts: encoded whole, one document at a time. Repeated
rows: each packed on its own. Ties: none, as numbers follow the order of rows within a task. Columns besides the key and
the text are dropped, so their names can't clash. An empty table gives an empty result. A null key stays null.
"""

from __future__ import annotations

import json
import os
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.bpe import CHUNK, MEMO
from ridgeline.llm.common import map_rows, written

#: Least part of a sequence that k pieces of class k fill.
FILL = 0.99


def cut(n: int, capacity: int, fill: float = FILL) -> list[tuple[int, int]]:
    """Lengths and classes of the pieces of n ids."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest < fill * capacity:
            k += 1
        size = min(rest, capacity // k)
        out.append((size, k))
        rest -= size
    return out


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write the printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(definition: dict) -> dict[bytes, int] | None:
    """Tokens by bytes if the tokenizer is plain byte-level BPE whose ids follow the order of its merges, else None."""
    model, pre = definition["model"], definition.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or definition.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocabulary, letters = model["vocab"], _byte_of_letter()
    added = {t["content"] for t in definition.get("added_tokens", [])}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    tokens = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}
    in_order = all(a < b for a, b in zip(merged, merged[1:])) and len(tokens) == len(merged) + 256
    return tokens if in_order else None


class Tokens:
    """The ids of a definition of the tokenizers library, behind a bounded memo of chunks that end where white space begins.

    Chunks of a plain byte-level BPE go through the faster tiktoken engine with the same merges; those that hold an added
    token, and all chunks of other definitions, through tokenizers itself.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        ranks = _ranks(parsed)
        self.fast = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.memo: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        out = b"".join([self.packed[i] for i in ids])
        if len(text) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, new = self.memo.get, self.chunk
        return b"".join([get(c) or new(c) for c in CHUNK.findall(text)])


def pieces(df: DataFrame, key: str, text: str, definition: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with task, class and number within both. definition: the JSON text of a tokenizer, of fixed size, so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(definition)
    end = end_id.to_bytes(4, "little")

    def make():
        tokens, task, numbers = Tokens(shared.value), TaskContext.get().partitionId(), {}

        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(t or "") + end
                n, start = len(ids) // 4, 0
                for length, kind in cut(n, capacity):
                    part = ids[4 * start : 4 * (start + length)]
                    number = numbers.get(kind, 0)
                    numbers[kind] = number + 1
                    rows.add(task, kind, number, k, start, length, zlib.crc32(part), n, *[part] * with_ids, size=80 + len(part) * with_ids)
                    start += length

        return step

    return map_rows(df.select(F.col(key).cast("long"), text), f"task long,kind long,number long,{key} long,start long,length long,ids_crc32 long,doc_tokens long" + ",ids binary" * with_ids, make)


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "kind", "place"], ascending=[False, True, True], kind="stable")
        room: list[int] = []
        bins, offsets, first = [], [], {}
        for n in pdf["length"].tolist():
            b = first.get(n, 0)  # no earlier sequence has room for this length
            while b < len(room) and room[b] < n:
                b += 1
            if b == len(room):
                room.append(capacity)
            first[n] = b
            bins.append(b)
            offsets.append(capacity - room[b])
            room[b] -= n
        return pdf.assign(bin=bins, offset=offsets)[["kind", "place", "bin", "offset"]]

    return run


def pack(df: DataFrame, key: str, text: str, definition: str, end_id: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids on request."""
    parts = written(pieces(df, key, text, definition, end_id, capacity, with_ids))
    counts = parts.groupBy("task", "kind").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # By class: at most `capacity` rows, whatever the input.
    kinds = counts.groupBy("kind").agg(F.sum("n").alias("total")).withColumn("bins", F.floor(F.col("total") / F.col("kind")))
    kinds = kinds.withColumn("first_bin", F.coalesce(F.sum("bins").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(kinds, "kind")
    placed = parts.join(starts, ["task", "kind"]).withColumn("place", F.col("base") + F.col("number"))
    whole = F.col("place") < F.col("bins") * F.col("kind")
    out = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    row = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.where(whole).withColumn("sequence_id", F.col("first_bin") + F.floor(F.col("place") / F.col("kind")))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0)))
    over = placed.where(~whole)
    fitted = over.select("kind", "place", "length", F.lit(0).alias("one")).groupBy("one").applyInPandas(_first_fit(capacity), "kind long, place long, bin long, offset long")
    used = kinds.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("used"))
    rest = over.join(fitted, ["kind", "place"]).join(F.broadcast(used)).withColumn("sequence_id", F.col("used") + F.col("bin"))
    return full.select(out).unionByName(rest.select(out))
