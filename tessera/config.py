"""Settings that change query results, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Every knob has a default; unknown names are refused by ``from_dict``."""

    top_k_tokens: int = 100
    top_k: int = 10
    ncells: int = 4
    ndocs: int = 1000
    centroid_score_threshold: float = 0.45
    nbits: int = 1
    partitions_coef: float = 2.0
    keyword_threshold: float = 0.0
    apply_weight: bool = False
    mask_punctuation: bool = True
    add_cls: bool = True
    query_max_length: int = 32
    max_length: int = 256
    query_pad: bool = False
    doc_marker: str | None = None
    query_marker: str | None = None
    first_token_only: bool = True
    ignore_label: int = -100
    kept_tags: tuple[int, ...] = ()
    ks: tuple[int, ...] = (1, 3, 5, 10, 30, 50, 100)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)
