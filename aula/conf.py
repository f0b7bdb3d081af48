"""Engine settings with validation, and per-lecture overlays."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

RERANK_MODES = ("replace", "blend")
#: Settings that a lecture may change, with their defaults.
LECTURE_DEFAULTS: dict[str, dict[str, float]] = {
    "keyframes": {"sample_interval": 1.0, "pixel_threshold": 40.0, "area_threshold": 0.02, "longest_gap": 60.0},
    "ocr_clean": {"share": 0.25, "least_frames": 5, "most_candidates": 80, "least_confidence": 0.3},
}


@dataclass(frozen=True)
class EngineConf:
    """``from_env`` reads ``AULA_<NAME>`` variables; a value that makes no sense is an error, not a default."""

    course_id: str = "course"
    encoder: str = "hash-64"
    token_limit: int = 3072
    signals: tuple[str, ...] = ("speech", "full", "bm25")
    candidates: int = 20
    rrf_k: int = 60
    top_k: int = 5
    rerank: bool = False
    rerank_mode: str = "replace"
    chunk_target: int = 350
    chunk_most: int = 450

    def __post_init__(self) -> None:
        if self.rerank_mode not in RERANK_MODES:
            raise ValueError(f"rerank_mode must be one of {RERANK_MODES}")
        if not 1 <= self.top_k <= 10:
            raise ValueError("top_k must lie between 1 and 10")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConf:
        env = dict(os.environ if env is None else env)
        given = {}
        for f in fields(cls):
            if (raw := env.get(f"AULA_{f.name.upper()}")) is not None:
                kind = type(f.default)
                given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return cls(**given)

    def snapshot(self) -> dict:
        return asdict(self)


def lecture_settings(folder: str | Path) -> dict[str, dict[str, float]]:
    """Defaults overlaid with ``settings.json`` of a lecture's folder; unknown sections and keys are errors."""
    out = {k: dict(v) for k, v in LECTURE_DEFAULTS.items()}
    file = Path(folder) / "settings.json"
    if not file.exists():
        return out
    for section, values in json.loads(file.read_text()).items():
        if section not in out:
            raise ValueError(f"unknown section {section!r}")
        for key, value in values.items():
            if key not in out[section]:
                raise ValueError(f"unknown setting {section}.{key}")
            out[section][key] = value
    return out


def check_question(question: str, lecture: str | None, known: list[str], top: int) -> str:
    """The trimmed question, or an error."""
    q = question.strip()
    if not q or len(q) > 1000:
        raise ValueError("a question has 1 to 1000 characters")
    if lecture is not None and lecture not in known:
        raise ValueError(f"unknown lecture {lecture!r}")
    if not 1 <= top <= 10:
        raise ValueError("top must lie between 1 and 10")
    return q
