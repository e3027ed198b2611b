"""Token counts of whole texts by a public tokenizer.

Huge texts are encoded in overlapping chunks with offsets.  Two neighbouring
chunks are spliced at a boundary that both found inside their overlap and that
is stable: a letter or digit before a blank or line feed.  No pre-token and no
special string spans such a place, so the tokens left of it depend on the text left of it
alone, and those right of it on the text right of it.  Where an overlap has no
such place it is widened, in the end to the whole text.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import small_batches, table_batch, tidy

#: Texts of one call of the tokenizer, in characters.
CALL_CHARS = 200_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and text[at - 1].isalnum()


def count_in_chunks(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text``, never encoding much more than ``chunk`` characters at once unless alignment fails."""

    def starts(a: int, b: int) -> list[int]:
        return [a + o[0] for o in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    total, begin, end = 0, 0, min(len(text), chunk)
    left = starts(begin, end)
    while end < len(text):
        width = overlap
        while True:
            again = max(begin, end - width)
            right_end = min(len(text), max(again + chunk, end + overlap))
            right = starts(again, right_end)
            known = set(right)
            at = next((p for p in reversed(left) if again < p < end and p in known and stable(text, p)), None)
            if at is not None:
                total += sum(p < at for p in left)
                left, begin, end = [p for p in right if p >= at], at, right_end
                break
            if again == begin:  # the overlap is the whole chunk: it becomes the left one, twice as long
                end = min(len(text), begin + 2 * (end - begin) + overlap)
                left = starts(begin, end)
                if end == len(text):
                    break
                width = overlap
            else:
                width *= 2
    return total + len(left)


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs(doc_id, text)``.

    Counts are those of the whole text encoded at once, without added special
    tokens; a null text counts as empty (0 tokens).  Repeated rows and null ids
    stay as they are; extra columns are ignored; an empty table gives no rows.
    path: the tokenizer's .json file, at the same place on every executor.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [0] * len(texts)
            held: list[int] = []
            size = 0

            def encode(held=held, counts=counts, texts=texts):
                for i, e in zip(held, tokenizer.encode_batch_fast([texts[i] for i in held], add_special_tokens=False), strict=True):
                    counts[i] = len(e)
                held.clear()

            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_in_chunks(tokenizer, text, chunk, overlap)
                    continue
                held.append(i)
                size += len(text)
                if size > CALL_CHARS:
                    encode()
                    size = 0
            if held:
                encode()
            n_bytes = [len(t.encode()) for t in texts]
            yield table_batch(schema, doc_id=batch.column(0).to_pylist(), n_bytes=n_bytes, n_tokens=counts, over_limit=[c > limit for c in counts])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
