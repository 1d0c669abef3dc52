"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where tokenizer files lie unless a path is given.
TOKENIZER = os.environ.get("ORRERY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


#: Characters that are tokenized at once, or one text if it is longer: bounds what a worker holds beside its batch.
_PIECE = 1 << 18


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """One tokenizer a Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def with_token_counts(df: DataFrame, text: Column, cols: dict[str, Column], tokenizer: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """``cols`` and the number of tokens of ``text``, whole, by the tokenizer file at ``tokenizer``.

    A null text has 0 tokens. Special tokens in a text are ordinary text.
    """
    rows = df.select(*[c.alias(k) for k, c in cols.items()], text.alias("t"))
    kept = [f.name for f in rows.schema.fields[:-1]]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{name}` long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from orrery.llm.tokens import _tokenizer

        encode = _tokenizer(tokenizer).encode_batch_fast
        for b in batches:
            texts = b.column(len(kept))
            n, held, chars = [], [], 0
            for x in texts:
                held.append(x.as_py() or "")
                chars += len(held[-1])
                if chars >= _PIECE:
                    n += map(len, encode(held, add_special_tokens=False))
                    held, chars = [], 0
            n += map(len, encode(held, add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(n, pa.int64())], [*kept, name])

    return rows.mapInArrow(count, ddl)
