"""Models as batch functions: loaded once a worker, called with batches of similar length.

A model is a loader without arguments that returns a function from a list of inputs to
as many outputs: of texts to term lists (a tokenizer), of texts to vectors (an encoder),
of (question, passage) pairs to scores (a cross-encoder).  Loaders travel to the
executors, models never do; nothing here knows where a model's weights come from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, Callable] = {}


@dataclass(frozen=True)
class Model:
    """A named loader; a worker keeps what it returns under the name."""

    name: str
    load: Callable[[], Callable[[list], list]]
    batch: int = 32

    def get(self) -> Callable[[list], list]:
        if self.name not in _loaded:
            _loaded[self.name] = self.load()
        return _loaded[self.name]

    def outputs(self, inputs: list, length: Callable[[object], int]) -> list:
        """One output for each input, which are given ``batch`` at a time, the longest first."""
        call, out = self.get(), [None] * len(inputs)
        order = sorted(range(len(inputs)), key=lambda k: -length(inputs[k]))
        for at in range(0, len(order), self.batch):
            part = order[at : at + self.batch]
            made = list(call([inputs[k] for k in part]))
            if len(made) != len(part):
                raise ValueError(f"{self.name} gave {len(made)} outputs for {len(part)} inputs")
            for k, value in zip(part, made, strict=True):
                out[k] = value
        return out


def applied(rows: DataFrame, model: Model, inputs: list[str], output: str, kind: str) -> DataFrame:
    """``rows`` with a column of the model's outputs for one text column, or for tuples of several; null texts are empty.

    Columns of the rows keep their place; one named as the output is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [c for c in rows.columns if c != output]
    out_type = _parse_datatype_string(kind)
    schema = StructType([*(rows.schema[c] for c in kept), StructField(output, out_type)])
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_input_{k}") for k, c in enumerate(inputs)]

    def run(batches):
        for batch in batches:
            columns = [batch.column(len(kept) + k).to_pylist() for k in range(len(inputs))]
            given = columns[0] if len(columns) == 1 else list(zip(*columns, strict=True))
            made = model.outputs(given, len if len(columns) == 1 else lambda x: sum(map(len, x)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(made, to_arrow_type(out_type))], names=[*kept, output])

    return rows.select(*kept, *texts).mapInArrow(run, schema)


def tokenized(rows: DataFrame, tokenizer: Model, text_col: str = "text", output: str = "terms") -> DataFrame:
    return applied(rows, tokenizer, [text_col], output, "array<string>")


def embedded(rows: DataFrame, encoder: Model, text_col: str = "text", output: str = "vector", prefix: str = "") -> DataFrame:
    """Vectors of texts; some encoders want queries and passages told apart by a prefix."""
    told = rows.withColumn("_told", F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit("")))) if prefix else rows
    return applied(told, encoder, ["_told" if prefix else text_col], output, "array<double>").drop("_told")


def pair_scores(pairs: DataFrame, scorer: Model, question: str = "question", passage: str = "passage", output: str = "score") -> DataFrame:
    return applied(pairs, scorer, [question, passage], output, "double")
