"""Token counts of whole texts, huge ones by overlapping chunks.

A text of up to ``chunk`` characters is encoded at once.  A longer one is encoded
in chunks that overlap.  Two neighbouring encodings are spliced at a token
boundary that both have and that is proven stable: it lies between a character
that is not a space and a space, and no piece of the vocabulary holds a space
after another character, so no merge can cross it and the text on either side
cannot change the tokens on the other.  Where the overlap has no such boundary,
it is doubled until it has one or reaches the end of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 512
SPACE = "▁"

_loaded: dict[str, object] = {}


def load(path: str):
    """The sentencepiece model, once per Python worker."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("pieces of this vocabulary hold a space after another character: no boundary is stable")
        _loaded[path] = model
    return _loaded[path]


def _boundaries(model, text: str) -> dict[int, int]:
    """Stable boundaries of a chunk: character position to number of tokens before it."""
    found, at, data = {}, 0, text.encode("utf-8")
    position = 0
    for n, piece in enumerate(model.encode(text, return_type="proto").pieces):
        position += len(data[at : piece.begin].decode("utf-8", "ignore"))
        at = piece.begin
        if 0 < position < len(text) and text[position] == " " and text[position - 1] not in (" ", SPACE):
            found.setdefault(position, n)
    return found


def count_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, encoded ``chunk`` characters at a time."""
    total, start, skip = 0, 0, 0
    while True:
        # text[start] is a space for all chunks but the first; the model puts one
        # before what it encodes, so it is left out here.
        origin = start + skip
        end, width = start + chunk, overlap
        while True:
            if end >= len(text):
                return total + len(model.encode(text[origin:]))
            left = text[origin : end + width]
            right_start = text.find(" ", end)
            if right_start >= 0 and right_start + 1 < len(text):
                ours = _boundaries(model, left)
                theirs = _boundaries(model, text[right_start + 1 : end + width])
                both = [p for p in ours if p + origin - right_start - 1 in theirs or p + origin == right_start]
                both = [p for p in both if p + origin >= right_start and p + origin + 1 < len(text)]
                if both:
                    cut = min(both)
                    total += ours[cut]
                    start, skip = origin + cut, 1
                    break
            if end + width >= len(text):
                return total + len(model.encode(text[origin:]))
            width *= 2


def count_batches(path: Callable[[], str], chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path())
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for at in range(0, len(short), 64):
                some = short[at : at + 64]
                for i, ids in zip(some, model.encode([texts[i] for i in some], num_threads=1), strict=True):
                    counts[i] = len(ids)
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_long(model, text, chunk, overlap)
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def vocabulary(name: str) -> Callable[[], str]:
    """Where the installed vocabulary files have ``name``; looked up on the executor."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def token_counts(
    docs: DataFrame, path: Callable[[], str], *, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) per row of ``docs``.

    ``path`` gives the model file on the executor that calls it.  A null or empty
    text has no bytes and no tokens.  Rows are independent: repeated rows give
    repeated results, an empty table an empty one; further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count_batches(path, chunk, overlap), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
