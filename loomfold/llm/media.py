"""Ogg media columns: texts stored as 8-bit samples, read back, and described."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ogg import read_pcm, write_pcm
from .shared import bounded_batches

BLOCK = 192


def pad_payload(text: bytes | None) -> bytes:
    """The bytes followed by 32s up to a positive multiple of 192."""
    data = text or b""
    return data + b" " * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def _store(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write_pcm(pad_payload(t)) for t in texts], pa.binary())],
                names=["rest", "n_bytes", "media"],
            )


def describe(samples: bytes, media: dict) -> str:
    """Length, loudness and zero crossings of unsigned 8-bit samples, with the container's counts; whole numbers only."""
    import numpy as np

    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    ends = [t[1] for t in media["times"] if t]
    energy = int((x * x).sum()) // len(x) if len(x) else 0
    crossed = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"ms={round(1000 * max(ends, default=0))};mean={int(x.sum()) // len(x) if len(x) else 0};energy={energy};crossings={crossed};packets={len(media['times'])};indexed={media['indexed']};pages={media['pages']};streams={media['streams']};damaged={media['damaged']}"


def _read(batches):
    import hashlib
    import zlib

    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows: list[list] = [[] for _ in range(6)]
            for media in part.column(2).to_pylist():
                got = read_pcm(media or b"")
                payload = got["samples"]
                for c, v in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), describe(payload, got)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], names=["rest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``rest`` (a struct of the other columns), ``n_bytes`` and ``media``: each text as an Ogg file of 8-bit samples.

    Null texts are empty ones, and an empty text is one block of spaces; texts of any length are stored whole, in memory one
    at a time; equal texts have equal files; repeated rows and nulls elsewhere pass through; an empty table gives no rows;
    further columns, whatever their names, are carried in ``rest`` only.
    """
    bounded_batches(docs.sparkSession)
    others = [docs[c] for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("nothing")]
    own = docs.select(F.struct(*others).alias("rest"), docs[text].cast("string").alias("body"))
    return own.mapInArrow(_store, f"rest {own.schema['rest'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What the Ogg files in ``media`` hold: payload and container digests and a feature string. A null or damaged file gives what can be read; an empty table gives no rows."""
    own = stored.select("rest", "n_bytes", "media")
    return own.mapInArrow(_read, f"rest {own.schema['rest'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as Ogg and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = read_media(store_texts(docs))
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
