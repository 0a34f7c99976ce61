"""Validated settings of filters, embeddings and clusterings.

Settings come as a mapping of texts, as a query string gives them; a blank text means the default. Anything
out of range raises ``ValueError``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any, ClassVar
from urllib.parse import urlencode

METRICS = ("jaccard", "overlap", "dice")
POINT_DISTANCES = ("binary", *METRICS)
LINKAGES = ("single", "complete", "average", "average_deduplicated", "weighted")
TARGETS = ("distance_threshold", "n_clusters", "persistence")
SCORE_MODES = ("rectangle", "integral")
ALL_PARTNERS = "__all__"

#: Other names that targets are known by.
TARGET_NAMES = {"cutoff": "distance_threshold", "clusters": "n_clusters", "lifetime": "persistence"}


def text_of(query: Mapping[str, Any], key: str, default: Any = "") -> str:
    """A trimmed text; of a list the first; the default where the key is missing."""
    raw = query.get(key, default)
    if isinstance(raw, (list, tuple)):
        raw = raw[0] if raw else default
    return str("" if raw is None else raw).strip()


def number(query: Mapping[str, Any], key: str, default, kind=float, least=None, most=None, above=None):
    """A number within its bounds; blank means the default."""
    raw = text_of(query, key)
    if raw == "":
        return default
    try:
        value = kind(raw)
    except ValueError:
        raise ValueError(f"{key} is not a number: {raw!r}") from None
    if kind is float and not math.isfinite(value):
        raise ValueError(f"{key} must be finite")
    if least is not None and value < least or most is not None and value > most or above is not None and value <= above:
        raise ValueError(f"{key} is out of range: {raw}")
    return value


def choice(query: Mapping[str, Any], key: str, default: str, allowed: tuple[str, ...]) -> str:
    value = text_of(query, key, default).lower() or default
    if value not in allowed:
        raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    return value


def flag(query: Mapping[str, Any], key: str, default: bool = False) -> bool:
    """1, true, yes and on are true; a missing or blank key is the default, all else is false."""
    raw = text_of(query, key).lower()
    return default if raw == "" else raw in {"1", "true", "yes", "on"}


def auto_or_positive(query: Mapping[str, Any], key: str) -> float | None:
    """None for ``auto`` or blank."""
    return None if text_of(query, key).lower() in {"", "auto"} else number(query, key, None, above=0)


@dataclass(frozen=True)
class FilterSettings:
    """rows need interfaces of this many residues on both sides; 0 turns the filter off."""

    min_interface_size: int = 5

    @classmethod
    def of(cls, query: Mapping[str, Any]) -> FilterSettings:
        return cls(number(query, "min_interface_size", cls.min_interface_size, int, least=0))


@dataclass(frozen=True)
class PageSettings:
    """row window of a page; ``limit`` None means all rows."""

    offset: int = 0
    limit: int | None = None

    @classmethod
    def of(cls, query: Mapping[str, Any], prefix: str = "row") -> PageSettings:
        return cls(number(query, f"{prefix}_offset", 0, int, least=0), number(query, f"{prefix}_limit", None, int, least=1))


@dataclass(frozen=True)
class EmbeddingSettings:
    """E6. ``None`` for perplexity and learning rate means automatic."""

    method: str = "pca"
    distance: str = "binary"
    perplexity: float | None = None
    learning_rate: float | None = None
    max_iter: int = 1000
    early_exaggeration_iter: int = 250
    early_exaggeration: float = 12.0
    neighbors: str = "approx"
    theta: float = 0.5
    random_state: int = 42

    @classmethod
    def of(cls, query: Mapping[str, Any]) -> EmbeddingSettings:
        return cls(
            choice(query, "embedding_method", cls.method, ("pca", "tsne")),
            choice(query, "distance", cls.distance, POINT_DISTANCES),
            auto_or_positive(query, "perplexity"),
            auto_or_positive(query, "learning_rate"),
            number(query, "max_iter", cls.max_iter, int, above=0),
            number(query, "early_exaggeration_iter", cls.early_exaggeration_iter, int, above=0),
            number(query, "early_exaggeration", cls.early_exaggeration, above=0),
            choice(query, "neighbors", cls.neighbors, ("approx", "auto", "exact")),
            number(query, "theta", cls.theta, least=0, most=1),
        )


@dataclass(frozen=True)
class ClusteringSettings:
    """C8. Exactly one of the targets holds for hierarchical clustering; the others' values are None."""

    DEFAULT_THRESHOLD: ClassVar[float] = 0.5

    method: str = "hierarchical"
    distance: str = "overlap"
    min_cluster_size: int = 25
    min_samples: int | None = None
    cluster_selection_epsilon: float = 0.25
    linkage: str = "average"
    hierarchical_target: str = "distance_threshold"
    n_clusters: int | None = None
    distance_threshold: float | None = DEFAULT_THRESHOLD
    persistence_min_lifetime: float = 0.05
    persistence_lifetime_weight: float = 0.5
    persistence_score_mode: str = "rectangle"
    hierarchical_min_cluster_size: int = 10

    @classmethod
    def of(cls, query: Mapping[str, Any]) -> ClusteringSettings:
        method = choice(query, "method", cls.method, ("hierarchical", "hdbscan"))
        target = text_of(query, "hierarchical_target").lower()
        target = TARGET_NAMES.get(target, target)
        if target and target not in TARGETS:
            raise ValueError(f"hierarchical_target must be one of {', '.join(TARGETS)}")
        k = number(query, "n_clusters", None, int, above=0)
        t = number(query, "distance_threshold", None, least=0)
        named_blank = "distance_threshold" in query and t is None
        if not target:
            if k is not None and t is not None:
                raise ValueError("give n_clusters or distance_threshold, not both")
            target = "n_clusters" if k is not None else "distance_threshold"
        if t is None and target == "distance_threshold" and not named_blank:
            t = cls.DEFAULT_THRESHOLD
        if method == "hierarchical":
            if target == "n_clusters" and k is None:
                raise ValueError("the n_clusters target needs n_clusters")
            if target == "distance_threshold" and t is None:
                raise ValueError("the distance_threshold target needs distance_threshold")
            k = k if target == "n_clusters" else None
            t = t if target == "distance_threshold" else None
        return cls(
            method,
            choice(query, "distance", cls.distance, METRICS),
            number(query, "min_cluster_size", cls.min_cluster_size, int, above=0),
            number(query, "min_samples", None, int, above=0),
            number(query, "cluster_selection_epsilon", cls.cluster_selection_epsilon, least=0),
            choice(query, "linkage", cls.linkage, LINKAGES),
            target,
            k,
            t,
            number(query, "persistence_min_lifetime", cls.persistence_min_lifetime, least=0),
            number(query, "persistence_lifetime_weight", cls.persistence_lifetime_weight, least=0, most=1),
            choice(query, "persistence_score_mode", cls.persistence_score_mode, SCORE_MODES),
            number(query, "hierarchical_min_cluster_size", cls.hierarchical_min_cluster_size, int, above=0),
        )


def to_query(*settings) -> str:
    """settings as a query string that ``of`` reads back; None and defaults of None are left out."""
    parts: dict[str, Any] = {}
    for s in settings:
        for key, value in asdict(s).items():
            key = {"method": "embedding_method"}.get(key, key) if isinstance(s, EmbeddingSettings) else key
            if value is not None and key != "random_state":
                parts[key] = value
    return urlencode(parts)


def cleaned_preferences(saved: Any, kinds: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """stored preferences (a JSON text or mapping) section by section; a section that does not
    validate falls back to its defaults. ``kinds`` names the settings class of each section."""
    if isinstance(saved, str):
        try:
            saved = json.loads(saved)
        except ValueError:
            saved = {}
    saved = saved if isinstance(saved, Mapping) else {}
    out = {}
    for name, kind in kinds.items():
        section = saved.get(name)
        try:
            out[name] = asdict(kind.of(section if isinstance(section, Mapping) else {}))
        except ValueError:
            out[name] = asdict(kind())
    return out
