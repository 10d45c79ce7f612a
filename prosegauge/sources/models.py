"""Model answers as a source (S6 to S9): clients are given, no network code is bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Called on an executor with a prompt; gives the answer's text.
Client = Callable[[str], str]
BACKENDS: dict[str, Callable[[str], Client]] = {}


def register(name: str, make: Callable[[str], Client]) -> None:
    BACKENDS[name] = make


def answers(prompts: DataFrame, model: str, backend: str, key: str = "id", prompt: str = "prompt") -> DataFrame:
    """(key, response, error): a failed call or an empty answer becomes an error row. Unknown backends raise ValueError."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; known: {', '.join(sorted(BACKENDS))}")
    make = BACKENDS[backend]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make(model)
        for batch in batches:
            said, wrong = [], []
            for text in batch.column(1).to_pylist():
                try:
                    answer = call(text)
                    said.append(answer if (answer or "").strip() else None)
                    wrong.append(None if said[-1] else "empty answer")
                except Exception as e:  # noqa: BLE001  a client's failure is a result here
                    said.append(None)
                    wrong.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(wrong, pa.string())], names=[key, "response", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInArrow(run, f"{key} {kind}, response string, error string")
