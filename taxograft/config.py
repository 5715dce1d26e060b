"""Settings of the pipelines as frozen dataclasses with unique leaf names, readable from flat or nested mappings."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column


def product_score(p_sup: Column, p_sub: Column) -> Column:
    return p_sup * p_sub


@dataclass(frozen=True)
class InsertionConfig:
    mode: str = "auto"
    rand_seed: Any = 114514
    transitive_reduction: bool = True
    logging: bool | int | tuple[str, ...] = 1
    max_outer_loop: int | None = None
    batch_size: int = 64
    semiauto_seeds: tuple[Any, ...] = ()
    input_concepts: tuple[str, ...] = ()
    manual_concept_bases: tuple[tuple[Any, ...], ...] | None = None
    auto_bases: bool = False
    retrieve_size: int = 10
    restrict_combinations: bool = True
    # Labels too general to be a concept.
    ignore_label: tuple[str, ...] = ("", "All categories", "Root Concept", "Thing", "Allcats", "Everything", "root")
    filter_subset: bool = True
    subgraph_crop: bool = True
    subgraph_force: tuple[tuple[str, ...], ...] = (("auto", "original"),)
    subgraph_strict: bool = True
    threshold: float = 0.5
    tolerance: int = 0
    force_base_subsumptions: bool = False
    force_prune: bool = False
    do_update: bool = True
    do_lexical_check: bool = True
    eqv_score_func: Callable[[Column, Column], Column] = field(default=product_score)


@dataclass(frozen=True)
class MoveConfig:
    """``ignore`` (targets of auto mode), ``ret_ignore`` (retrieved candidates) and ``sub_ignore`` (nodes of the search space) are ids, or a
    pattern that labels match from their start."""

    mode: str = "auto"
    method: str = "search"
    rand_seed: Any = 114514
    logging: bool | int | tuple[str, ...] = 1
    max_outer_loop: int | None = None
    ignore: str | tuple[int, ...] = ()
    input_concepts: tuple[int, ...] = ()
    retrieve_size: int = 10
    candidate_top_level: int = -1
    candidate_bottom_level: int = 1
    ret_ignore: str | tuple[int, ...] = ()
    do_generate: bool = False
    scope_top_level: int = 0
    scope_bottom_level: int = 1
    sub_ignore: str | tuple[int, ...] = ()
    threshold: float = 0.5
    tolerance: int = 0
    force_prune: bool = False
    always_search_to_bottom: bool = True
    do_select: bool = True
    always_include_old: bool = True
    selection_features: tuple[str, ...] = ("parent", "siblings")
    weights: tuple[float, ...] = (1.0, 1.0)
    do_update: bool = True


def _flat(values: Mapping[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in values.items():
        out.update(_flat(v) if isinstance(v, Mapping) else {k: v})
    return out


def _tuple(v: Any) -> Any:
    return tuple(_tuple(x) for x in v) if isinstance(v, (list, tuple)) else v


def from_dict(kind: type, values: Mapping[str, Any]) -> Any:
    """A config of the kind from flat or nested keys; unknown keys are left out with a warning, the score function is not data. A compiled
    pattern counts by its text."""
    flat = _flat(values)
    known = {f.name for f in fields(kind)} - {"eqv_score_func"}
    if unknown := sorted(set(flat) - known):
        warnings.warn(f"unknown settings: {', '.join(unknown)}", stacklevel=2)
    return kind(**{k: _tuple(getattr(v, "pattern", v)) for k, v in flat.items() if k in known})


def from_yaml(kind: type, path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(kind, yaml.safe_load(f) or {})


def from_json_file(kind: type, path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return from_dict(kind, json.load(f))


def update(config: Any, **changes: Any) -> Any:
    """The config with leaves changed; an unknown name is a KeyError."""
    for name in changes:
        if name not in {f.name for f in fields(config)}:
            raise KeyError(name)
    return replace(config, **{k: _tuple(v) for k, v in changes.items()})
