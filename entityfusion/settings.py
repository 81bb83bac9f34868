"""Weights, reliabilities and policies: fixed defaults, or a folder of YAML files that says otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

#: Reliability of sources, and of some of their fields.
RELIABILITY = {"recruiter_csv": 0.75, "ats_json": 0.90, "resume_pdf": 0.80, "resume_docx": 0.80, "github": 0.70, "linkedin": 0.65, "recruiter_notes": 0.55}
OVERRIDES = {
    "recruiter_csv": {"emails": 0.80, "phones": 0.76, "skills": 0.74, "experience": 0.72, "education": 0.70},
    "ats_json": {"emails": 0.95, "phones": 0.90, "skills": 0.84, "experience": 0.92, "education": 0.89},
    "resume_pdf": {"emails": 0.82, "phones": 0.70, "skills": 0.95, "experience": 0.91, "education": 0.90},
    "github": {"emails": 0.60, "phones": 0.20, "skills": 0.88, "experience": 0.55, "education": 0.30},
}
#: What a field's merge is called, weights of a field's score and of categories, caps.
POLICIES = {"emails": "union", "phones": "union", "skills": "semantic_union", "experience": "chronological_merge", "education": "merge", "current_company": "highest_confidence_recent"}
WEIGHTS = {"reliability": 0.30, "agreement": 0.25, "quality": 0.20, "certainty": 0.20, "conflict": 0.05, "missing": 0.10}
CATEGORY_WEIGHTS = {"identity": 0.30, "experience": 0.25, "skills": 0.20, "education": 0.15, "location": 0.05, "context": 0.05}
CAPS = {"single_source": 0.85, "conflict": 0.78}
#: Names of weights and caps in files.
WEIGHT_NAMES = {"source_reliability_weight": "reliability", "cross_source_agreement_weight": "agreement", "extraction_quality_weight": "quality", "semantic_certainty_weight": "certainty", "conflict_penalty_weight": "conflict", "missing_value_penalty_weight": "missing"}
CAP_NAMES = {"single_source_max": "single_source", "unresolved_conflict_max": "conflict"}


@dataclass(frozen=True)
class Settings:
    reliability: dict[str, float] = field(default_factory=lambda: dict(RELIABILITY))
    overrides: dict[str, dict[str, float]] = field(default_factory=lambda: {s: dict(o) for s, o in OVERRIDES.items()})
    policies: dict[str, str] = field(default_factory=lambda: dict(POLICIES))
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    category_weights: dict[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    caps: dict[str, float] = field(default_factory=lambda: dict(CAPS))
    default_reliability: float = 0.5
    case_insensitive: bool = True


DEFAULT = Settings()


def _mapping(folder: Path, name: str) -> dict:
    """The mapping in a YAML file; a missing or empty file is an empty one."""
    import yaml

    path = folder / f"{name}.yml"
    made = (yaml.safe_load(path.read_text(encoding="utf-8-sig")) or {}) if path.exists() else {}
    if not isinstance(made, dict):
        raise ValueError(f"{path} holds no mapping")
    return made


def load_settings(folder: str) -> Settings:
    """Settings of ``fusion.yml``, ``confidence.yml`` and ``source_reliability.yml``; what they don't say keeps its default.

    An empty mapping for category weights is kept: scores are then averaged by sources."""
    fusion, confidence, sources = (_mapping(Path(folder), name) for name in ("fusion", "confidence", "source_reliability"))
    numbers = lambda table: {str(k): float(v) for k, v in (table or {}).items()}
    told: dict = {}
    if "reliability" in sources:
        told["reliability"] = numbers(sources["reliability"])
    if "field_overrides" in sources:
        told["overrides"] = {str(s): numbers(o) for s, o in (sources["field_overrides"] or {}).items()}
    if "merge_policies" in fusion:
        told["policies"] = {str(k): v for k, v in (fusion["merge_policies"] or {}).items() if isinstance(v, str) and v}
    if "case_insensitive" in (fusion.get("identity_resolution") or {}):
        told["case_insensitive"] = bool(fusion["identity_resolution"]["case_insensitive"])
    if "category_weights" in confidence:
        told["category_weights"] = numbers(confidence["category_weights"])
    for key, names, default in (("score_components", WEIGHT_NAMES, "weights"), ("caps", CAP_NAMES, "caps")):
        given = {names[k]: float(v) for k, v in (confidence.get(key) or {}).items() if k in names}
        if given:
            told[default] = {**getattr(DEFAULT, default), **given}
    return replace(DEFAULT, **told)
