"""Settings of an engine; frozen, stored with every corpus, never global."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from enum import IntEnum

# Fixed values of the data model.
MAX_TOKENS = 512
MIN_TOKEN_LENGTH, MAX_TOKEN_LENGTH = 2, 255
CANDIDATES = 2048
HALF_WINDOW = 5
PASS1_SHARE, PASS2_SHARE = 0.7, 0.3
SUBWORD_PIECES, SUBWORD_LENGTH = 8, 24
INT8 = 127
EPSILON = 1e-10
PROXIMITY_BOOST = 0.10
EDGE_SCORE, EDGES_PER_NODE = 0.75, 10
SPARSE_DEFAULT = 32
CHUNK_CAP, FILE_CAP_DEFAULT, FILE_CAP_MOST = 16 << 20, 64 << 20, 256 << 20


class Mode(IntEnum):
    """How a search finds its candidates."""

    AUTO = 0
    BRUTE = 1
    FAST = 2
    TFIDF = 3


@dataclass(frozen=True)
class Weights:
    """Weights of the six signals of the combined score."""

    tfidf: float
    ri: float
    api: float
    type: float
    deco: float
    struct: float


WEIGHTS = {768: Weights(0.20, 0.25, 0.15, 0.10, 0.05, 0.10), 256: Weights(0.25, 0.15, 0.18, 0.12, 0.07, 0.10)}


@dataclass(frozen=True)
class EngineConfig:
    """``dim`` of vectors, IDF weighting, abbreviation expansion, co-occurrence enrichment, sparse storage (0: dense)."""

    dim: int = 768
    idf: bool = True
    abbrev: bool = True
    ri: bool = False
    sparse_nnz: int = 0
    mode: Mode = Mode.BRUTE
    threshold: float = EDGE_SCORE
    max_edges: int = EDGES_PER_NODE
    candidates: int = CANDIDATES
    index: bool = True
    max_docs: int | None = None
    max_file_bytes: int = FILE_CAP_DEFAULT
    weights: Weights = field(default=WEIGHTS[768])

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError(f"dim must be positive, not {self.dim}")
        object.__setattr__(self, "sparse_nnz", max(0, min(self.sparse_nnz, self.dim)))

    @classmethod
    def of(cls, dim: int = 768, **settings: object) -> EngineConfig:
        """Defaults for a dimension."""
        return cls(dim=dim, **({"weights": WEIGHTS.get(dim, WEIGHTS[768])} | settings))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **settings: object) -> EngineConfig:
        """Defaults, then the environment's switches: SEMALOOM_THRESHOLD in (0, 1], SEMALOOM_NO_ABBREV, SEMALOOM_NO_IDF, SEMALOOM_RI, SEMALOOM_MAX_FILE_SIZE."""
        env = os.environ if env is None else env
        on = lambda name: env.get(name, "")[:1] in ("1", "t", "T", "y", "Y")
        config = cls.of(**settings)  # type: ignore[arg-type]
        try:
            threshold = float(env.get("SEMALOOM_THRESHOLD", ""))
        except ValueError:
            threshold = 0.0
        if 0 < threshold <= 1:
            config = replace(config, threshold=threshold)
        size = env.get("SEMALOOM_MAX_FILE_SIZE", "")
        if size.isdigit() and int(size):
            config = replace(config, max_file_bytes=min(int(size), FILE_CAP_MOST))
        return replace(config, abbrev=config.abbrev and not on("SEMALOOM_NO_ABBREV"), idf=config.idf and not on("SEMALOOM_NO_IDF"), ri=config.ri or on("SEMALOOM_RI"))

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"mode": int(self.mode)}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        got = json.loads(text)
        return cls(**(got | {"mode": Mode(got["mode"]), "weights": Weights(**got["weights"])}))
