"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeweave.session import spread

#: Folder of the tokenizers' files; the cluster's place may be given by this session setting.
SETTING, FOLDER = "spark.lodeweave.tokenizers", "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"


@lru_cache(maxsize=1)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def sized(documents: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """The kept columns and n_tokens of each text; NULL and empty texts have none (0)."""
    path = documents.sparkSession.conf.get(SETTING, FOLDER) + "/" + model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = processor.encode([t or "" for t in part.column(0).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(list(map(len, ids)), pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(documents.select(*keep).dtypes)
    return spread(documents.select("text", *keep)).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
