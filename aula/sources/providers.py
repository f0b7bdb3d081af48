"""External models behind one interface, with deterministic stand-ins.

A provider is a function from a list of inputs to a list of outputs, registered by kind (``audio`` of a video, ``speech``, ``ocr``, ``vision``,
``encoder``, ``pair``, ``answer``) and name. ``apply`` runs one over a column in Arrow batches. None of the real models is part of
this repository; the stand-ins named ``echo`` and ``hash`` exist so that plans around them can be run and tested.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list], list]
_REGISTRY: dict[tuple[str, str], Provider] = {}
KINDS = ("audio", "speech", "ocr", "vision", "encoder", "pair", "answer")


def register(kind: str, name: str, provider: Provider) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    _REGISTRY[kind, name] = provider


def get(kind: str, name: str) -> Provider:
    if (kind, name) not in _REGISTRY:
        raise ValueError(f"no {kind} provider named {name!r}")
    return _REGISTRY[kind, name]


def with_retries(provider: Provider, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """Waits ``wait``, then twice as long, and so on; the last error is raised."""

    def run(batch: list) -> list:
        for k in range(attempts):
            try:
                return provider(batch)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(wait * 2**k)
        return []

    return run


class RateLimit:
    """Evenly spaced slots, shared by the threads of one process."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next, self.lock = 60.0 / per_minute, clock, sleep, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            slot = max(now, self.next)
            self.next = slot + self.gap
        if slot > now:
            self.sleep(slot - now)


#: Kinds of results: a plain type, a vector, speech segments of a recording, tokens of an image, a model's answer.
RESULT_TYPES: dict[str, tuple[str, pa.DataType]] = {
    "string": ("string", pa.string()),
    "double": ("double", pa.float64()),
    "array<double>": ("array<double>", pa.list_(pa.float64())),
    "segments": ("array<struct<start_timestamp:double,end_timestamp:double,text:string>>", pa.list_(pa.struct([("start_timestamp", pa.float64()), ("end_timestamp", pa.float64()), ("text", pa.string())]))),
    "tokens": ("array<struct<token:string,confidence:double>>", pa.list_(pa.struct([("token", pa.string()), ("confidence", pa.float64())]))),
    "reply": ("struct<coverage:string,answer:string>", pa.struct([("coverage", pa.string()), ("answer", pa.string())])),
}


def one_by_one(provider: Provider) -> Provider:
    """If a batch fails, each of its inputs is tried on its own; those that fail again give None."""

    def run(batch: list) -> list:
        try:
            return provider(batch)
        except Exception:
            out = []
            for x in batch:
                try:
                    out += provider([x])
                except Exception:
                    out.append(None)
            return out

    return run


def apply(df: DataFrame, column: str, out: str, provider: Provider, kind: str = "string", *, skip_errors: bool = False) -> DataFrame:
    """Distinct non-null inputs go through the provider once; results are joined back (NULL in, NULL out).

    With ``skip_errors`` an input that fails has a NULL result; without, it fails the job.
    """
    name, arrow = RESULT_TYPES[kind]
    call = one_by_one(provider) if skip_errors else provider

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(call(b.column(0).to_pylist()), arrow)], ["_in", out])

    made = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_in")).distinct().mapInArrow(run, f"_in string, {out} {name}")
    return df.join(made, df[column] == made["_in"], "left").drop("_in")


def apply_pending(df: DataFrame, column: str, out: str, provider: Provider) -> DataFrame:
    """Only rows whose ``out`` is NULL (not done yet) go through; '' means done and empty and is kept."""
    done, todo = df.filter(F.col(out).isNotNull()), df.filter(F.col(out).isNull()).drop(out)
    return done.unionByName(apply(todo, column, out, provider))


def hash_vectors(texts: list[str]) -> list[list[float]]:
    out = []
    for t in texts:
        digest = hashlib.sha256(t.encode()).digest()
        out.append([b / 255 - 0.5 for b in digest[:8]])
    return out


def count_over_limit(tokens: list[int], limit: int) -> int:
    return sum(1 for n in tokens if n > limit)


register("encoder", "hash", hash_vectors)
def echo_answers(prompts: list[str]) -> list[dict]:
    """The question as an answer; short prompts count as partly covered, and a question with "not" as not covered."""
    out = []
    for p in prompts:
        question = p.split("\n", 1)[0]
        coverage = "none" if " not " in question else "partial" if len(p) < 2000 else "full"
        out.append({"coverage": coverage, "answer": f"{question} [1]. See also the rest [2, 9]."})
    return out


register("answer", "echo", echo_answers)
register("audio", "echo", lambda videos: [f"{v.rsplit('.', 1)[0]}.wav" for v in videos])
register("speech", "echo", lambda paths: [[{"start_timestamp": 0.0, "end_timestamp": 1.0, "text": f"sound of {p}"}] for p in paths])
register("ocr", "echo", lambda paths: [[{"token": t, "confidence": 0.9} for t in p.split("/")] for p in paths])
register("vision", "echo", lambda paths: [f"picture {p}" for p in paths])
