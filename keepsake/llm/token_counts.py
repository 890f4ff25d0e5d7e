"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved offline (``pretokens.load_vocabulary``). In a task the
pre-tokens of a slice are matched against those strings by hash and count as one directly; only the distinct rest is
merged by the library, once for each worker while it is remembered. No shuffle; a task holds one slice of texts.

Hashes are 64 bits wide: two different pre-tokens of a worker's table (at most 1.3 million) meet with a probability
below 1e-7.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm import kernels as K
from keepsake.llm import pretokens as P


def count_tokens(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every text, as the library of the vocabulary file counts them.

    ``.json``: tokenizers; byte-level BPE files take the shortcut, others go through the library text by text.
    ``.model``: sentencepiece. Special strings inside texts are read as the library does by default; begin and end
    tokens are not added. A null text counts as empty (0 bytes, 0 tokens), a null id stays null, each row gives one
    row (also repeated ones), an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long"
    if path.endswith(".model"):
        with open(path, "rb") as f:
            model = docs.sparkSession.sparkContext.broadcast(f.read())
        counter = _pieces(model)
    else:
        counter = _pretokens(docs.sparkSession.sparkContext.broadcast(P.load_vocabulary(path)))

    def count(batches):
        numbers = counter()
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, offsets = K.text_bytes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(numbers(part, data, offsets))],
                    ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema)


def _pretokens(shared):
    def open_counter():
        vocabulary = shared.value
        if vocabulary.fast:
            memory = P.memory_for(vocabulary)
            return lambda part, data, offsets: P.row_counts(data, offsets, memory)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(vocabulary.definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda part, data, offsets: np.array(
            [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in part.column("text").to_pylist()],
            np.int64)

    return open_counter


def _pieces(shared):
    def open_counter():
        from sentencepiece import SentencePieceProcessor
        processor = SentencePieceProcessor(model_proto=shared.value)
        return lambda part, data, offsets: np.array(
            [len(processor.encode(t or "")) for t in part.column("text").to_pylist()], np.int64)

    return open_counter
