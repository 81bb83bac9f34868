"""Dictionaries of skills, companies, job titles, degrees and countries: own entries, or YAML files of the same shape."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import TERMS

#: Entries: canonical name, aliases, category, parent category, related entries.
ENTRIES = {
    "skills": (
        ("Python", ("py", "python3", "python 3", "cpython"), "programming_language", "engineering", ("Pandas",)), ("Java", ("jdk", "java se"), "programming_language", "engineering", ("Spring",)),
        ("Scala", ("scala lang",), "programming_language", "engineering", ("Apache Spark",)), ("Go", ("golang",), "programming_language", "engineering", ()), ("Rust", ("rust lang",), "programming_language", "engineering", ()),
        ("TypeScript", ("ts", "type script"), "programming_language", "engineering", ()), ("JavaScript", ("js", "java script", "ecmascript"), "programming_language", "engineering", ()), ("C++", ("cpp", "c plus plus"), "programming_language", "engineering", ()),
        ("SQL", ("structured query language",), "query_language", "data", ()), ("PostgreSQL", ("postgres", "postgre sql"), "database", "data", ("SQL",)), ("MySQL", ("my sql",), "database", "data", ("SQL",)), ("Redis", ("redis cache",), "database", "data", ()),
        ("Apache Spark", ("spark", "pyspark"), "data_framework", "data", ("Scala",)), ("Apache Kafka", ("kafka",), "data_framework", "data", ()), ("Pandas", ("pandas library",), "data_framework", "data", ("Python",)),
        ("TensorFlow", ("tensor flow", "tf"), "machine_learning", "data", ("Python",)), ("PyTorch", ("torch", "py torch"), "machine_learning", "data", ("Python",)), ("Docker", ("docker engine", "containers"), "infrastructure", "operations", ()),
        ("Kubernetes", ("k8s", "kube"), "infrastructure", "operations", ("Docker",)), ("REST API Development", ("rest api", "rest apis", "restful services"), "backend", "engineering", ()), ("Django", ("django framework",), "backend", "engineering", ("Python",)), ("Git", ("git scm",), "tooling", "engineering", ()),
    ),
    "companies": (
        ("Northwind Labs", ("northwind", "northwind laboratories"), "technology", None, ()), ("Blue Harbor", ("blue harbor inc", "blueharbor"), "technology", None, ()), ("Acorn Systems", ("acorn", "acorn systems ltd"), "technology", None, ()),
        ("Helio Energy", ("helio", "helio energy corp"), "energy", None, ()), ("Meridian Bank", ("meridian", "meridian bank plc"), "finance", None, ()), ("Quarry Retail", ("quarry", "quarry stores"), "retail", None, ()),
    ),
    "job_titles": (
        ("Software Engineer", ("software developer", "developer", "programmer", "sde"), "engineering", None, ()), ("Backend Engineer", ("backend developer", "server engineer"), "engineering", None, ()), ("Data Engineer", ("etl developer",), "data", None, ()),
        ("Data Scientist", ("ml scientist",), "data", None, ()), ("Product Manager", ("pm", "product owner"), "product", None, ()), ("Engineering Manager", ("em", "dev manager"), "management", None, ()),
    ),
    "degrees": (
        ("Bachelor of Science", ("bsc", "b.sc", "bs", "b.s."), "bachelor", None, ()), ("Bachelor of Technology", ("btech", "b.tech", "b tech"), "bachelor", None, ()), ("Master of Science", ("msc", "m.sc", "ms", "m.s."), "master", None, ()),
        ("Master of Business Administration", ("mba", "m.b.a."), "master", None, ()), ("Doctor of Philosophy", ("phd", "ph.d", "ph.d."), "doctorate", None, ()),
    ),
    "countries": (
        ("United States", ("usa", "us", "united states of america"), "US", None, ()), ("United Kingdom", ("uk", "great britain"), "GB", None, ()), ("India", ("bharat",), "IN", None, ()), ("Germany", ("deutschland",), "DE", None, ()), ("France", ("république française",), "FR", None, ()),
        ("Canada", (), "CA", None, ()), ("Brazil", ("brasil",), "BR", None, ()), ("Japan", ("nippon",), "JP", None, ()), ("China", ("prc",), "CN", None, ()), ("Kenya", (), "KE", None, ()), ("Egypt", (), "EG", None, ()), ("Peru", ("perú",), "PE", None, ()),
    ),
}


def rows(domain: str, entries) -> list[tuple]:
    """Terms of a dictionary; for countries the category is the two-letter code, kept as metadata."""
    out = []
    for i, (name, aliases, category, parent, related) in enumerate(entries):
        meta = {"iso2": category} if domain == "countries" else {}
        kind = "country" if domain == "countries" else category
        for j, term in enumerate((name, *aliases)):
            out.append((domain, i, j, term, term.strip().lower(), j > 0, name, kind, parent, list(related), meta))
    return out


def terms(spark: SparkSession, domains: tuple[str, ...] = tuple(ENTRIES)) -> DataFrame:
    """The own dictionaries as one table."""
    return spark.createDataFrame([r for d in domains for r in rows(d, ENTRIES[d])], TERMS)


def read_yaml(spark: SparkSession, domain: str, path: str) -> DataFrame:
    """Terms of a YAML file: ontology_name, version, entries (canonical_name, aliases, category, parent_category, related_to, metadata)."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"dictionary: {path}")
    data = yaml.safe_load(file.read_text(encoding="utf-8-sig"))
    if not isinstance(data, dict) or "entries" not in data or "ontology_name" not in data:
        raise ValueError(f"malformed dictionary: {path}")
    made = []
    for i, e in enumerate(data["entries"] or ()):
        if not e.get("canonical_name") or not e.get("category"):
            raise ValueError(f"{path}: entry {i} lacks a name or category")
        meta = {str(k): str(v) for k, v in (e.get("metadata") or {}).items()}
        for j, term in enumerate((e["canonical_name"], *(e.get("aliases") or ()))):
            made.append((domain, i, j, term, term.strip().lower(), j > 0, e["canonical_name"], e["category"], e.get("parent_category"), list(e.get("related_to") or ()), meta))
    return spark.createDataFrame(made, TERMS)
