"""Lines repeated over documents, found by streaming sorted hashes; the result is a keep bitmap per document.

Only (hash, document, position) rows are shuffled, never text. They are
range-partitioned and sorted by hash, document (largest first) and position, so
one pass over a partition sees every key's first occurrence first. A key with very
many lines is cut over several partitions by the range itself; two summary rows
per partition tell its total.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import WHITE, cut_lineage, fresh, id_and_text, in_batches, text_key, work_folder

_WHITE = WHITE.encode()


def line_key(line: str) -> bytes:
    """A line without white space at its ends and with A-Z lower-cased."""
    return line.encode().strip(_WHITE).lower()


def line_hashes(docs: DataFrame, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id, text_key, pos): one row per line whose key has at least ``least_chars`` code points."""
    keyed = id_and_text(docs, id_col, text_col).withColumn("text_key", text_key())
    schema = T.StructType(
        [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), keyed.schema["doc_id"],
         T.StructField("text_key", T.LongType()), T.StructField("pos", T.IntegerType())]
    )

    def rows(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for doc, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for pos, line in enumerate((text or "").split("\n")):
                    if len(line) >= least_chars and len(short := line.strip(WHITE)) >= least_chars:
                        d = digest(short.encode().lower())
                        yield (
                            int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                            doc, key, pos,
                        )

    return keyed.mapInArrow(lambda it: in_batches(schema, rows(it), 20_000), schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, where a key begins, where a document within a key begins) of each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        docs = b.column(2).dictionary_encode()
        code = docs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        key = np.ones(b.num_rows, dtype=bool)
        key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        doc = key.copy()
        doc[1:] |= code[1:] != code[:-1]
        yield b, key, doc


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The first and the last key of a sorted partition with their numbers of documents here."""
    shard, first, last, n, doc_before = TaskContext.get().partitionId(), None, None, 0, None
    for b, key, doc in _runs(batches):
        begins = np.flatnonzero(key)
        name = lambda i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())  # noqa: B023, E731
        counts = np.add.reduceat(doc.astype(np.int64), begins)
        head = name(0)
        if head == last:  # the run goes on from the batch before
            counts[0] += n - (b.column(2)[0].as_py() == doc_before)
        elif last is not None and first is None:
            first = (last, n)
        if len(begins) > 1 and first is None:
            first = (head, int(counts[0]))
        last, n, doc_before = name(int(begins[-1])), int(counts[-1]), b.column(2)[b.num_rows - 1].as_py()
    if last is not None:
        if first is not None:
            yield (shard, 0, *first[0], first[1])
        yield (shard, 1, *last, n)


def _dropped(batches: Iterator[pa.RecordBatch], split: dict, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows to drop. ``split``: key cut over partitions -> (documents in all, partition in which it begins)."""
    shard, held, decided = TaskContext.get().partitionId(), None, None

    def judge(rows: pa.RecordBatch, end: bool):
        """(rows to drop, rows of the last key when it can't be judged yet, its name when all that follow go)."""
        (b, key, doc), = _runs(iter([rows]))
        begins = np.flatnonzero(key)
        run = np.cumsum(key) - 1
        nth = np.cumsum(doc)
        nth = nth - nth[begins][run]  # 0: the first document of the key in these rows
        total = np.add.reduceat(doc.astype(np.int64), begins)
        keep_first = np.ones(len(begins), dtype=bool)
        h1, h2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        name = lambda i: (int(h1[begins[i]]), int(h2[begins[i]]))
        for i in {0, len(begins) - 1}:
            if (name(i)) in split:
                total[i], home = split[name(i)]
                keep_first[i] = home == shard
            if name(i) == decided:
                total[i], keep_first[i] = least_docs, False
        drop = (total[run] >= least_docs) & ~(keep_first[run] & (nth == 0))
        go_on = not end and name(-1) != decided
        if go_on and (total[-1] < least_docs or not (nth[begins[-1] :] > 0).any()):
            drop[begins[-1] :] = False
            return drop, b.slice(int(begins[-1])), None
        return drop, None, name(-1)

    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        drop, held, decided = judge(b, False)
        yield b.select([2, 3, 4]).filter(pa.array(drop))
    if held is not None:
        drop, _, _ = judge(held, True)
        yield held.select([2, 3, 4]).filter(pa.array(drop))


def keep_bitmaps(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep_bitmap) for each document that loses lines; all others keep every line.

    A line goes when its key has ``least_chars`` code points or more, is found in
    ``least_docs`` documents or more, and this document is not the one with the largest id.
    Rows that share an id count as one document; a null id is the smallest.
    The bitmap is zlib-compressed, one bit per line from the first, 1 to keep; lines
    beyond its end are kept. Null and empty texts have one empty line. No document: no row.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark, "checkpoints"))
    hashes = cut_lineage(line_hashes(docs, least_chars, id_col, text_col), "line_hashes")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    dealt = (
        hashes.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos").checkpoint()
    )
    edge = "shard int, last int, h1 long, h2 long, n long"
    edges = T._parse_datatype_string(edge)
    totals: dict[tuple, list[int]] = {}
    for r in sorted(dealt.mapInArrow(lambda it: in_batches(edges, _edges(it)), edges).collect()):  # two per partition
        totals.setdefault((r.h1, r.h2), [0, r.shard, 0])
        totals[r.h1, r.h2][0] += r.n
        totals[r.h1, r.h2][2] += 1
    split = spark.sparkContext.broadcast({k: (n, home) for k, (n, home, times) in totals.items() if times > 1})
    gone = T.StructType(dealt.schema.fields[2:])
    arrow = to_arrow_schema(gone)

    def dropped(batches):
        for b in _dropped(batches, split.value, least_docs):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=True)], schema=arrow)

    per_doc = dealt.mapInArrow(dropped, gone).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    schema = T.StructType(
        [*gone.fields[:2], T.StructField("n_dropped", T.LongType()), T.StructField("keep_bitmap", T.BinaryType())]
    )

    def bitmaps(batches):
        for b in batches:
            for doc, key, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keep = np.ones(-(-(max(at) + 1) // 8) * 8, dtype=np.uint8)  # whole bytes: lines beyond stay
                keep[at] = 0
                yield doc, key, len(at), zlib.compress(np.packbits(keep, bitorder="little").tobytes())

    return per_doc.mapInArrow(lambda it: in_batches(schema, bitmaps(it)), schema)


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, list[str]]:
    """(number of lines, those kept)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)].tolist()
    return len(lines), [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]


def _joined(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    names = fresh(docs, "line_id", "line_text_key", "line_n_dropped", "line_bitmap")
    right = bitmaps.toDF(*names)
    left = docs.withColumn(key := fresh(docs, "own_text_key")[0], text_key(f"`{text_col}`"))
    on = left[f"`{id_col}`"].eqNullSafe(right[names[0]]) & (left[key] == right[names[1]])
    return left.join(right, on, "left").drop(key, *names[:3]), names[3]


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text; the other columns, and null texts, stay as they are."""
    joined, bitmap = _joined(docs, bitmaps, id_col, text_col)
    schema, i, j = docs.schema, docs.columns.index(text_col), len(docs.columns)
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for b in batches:
            text = [
                t if m is None else "\n".join(kept_lines(t, m)[1])
                for t, m in zip(b.column(i).to_pylist(), b.column(j).to_pylist(), strict=True)
            ]
            columns = [*b.columns[:i], pa.array(text, arrow[i].type), *b.columns[i + 1 : j]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], bitmap).mapInArrow(rows, schema)


def line_report(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, and the SHA-256 of the kept lines joined by line feeds."""
    joined, bitmap = _joined(docs, bitmaps, id_col, text_col)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()),
         T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    )

    def rows(batches):
        for b in batches:
            for doc, text, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, kept = kept_lines(text, bits)
                yield doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()

    chosen = joined.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), bitmap)
    return chosen.mapInArrow(lambda it: in_batches(schema, rows(it)), schema)
