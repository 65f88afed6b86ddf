"""Seed lists and contact lists out of YAML (or the same structure from anywhere else), checked and with defaults."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import TERM
from ..schemas import CONTACT_CAMPUSES, DOCUMENT_CAMPUSES, DOCUMENT_LEVELS, EVERGREEN, SCHEMAS

SEED_DEFAULTS = {"max_depth": 0, "follow": [], "follow_pdfs": True, "max_pages": 20, "campus": "N/A", "academic_level": "N/A", "term": EVERGREEN}


def read_yaml(path: str | Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML takes PyYAML; pass the structure itself instead") from e
    return yaml.safe_load(Path(path).read_text()) or {}


def _once(names: list[str], what: str) -> None:
    twice = [n for n, k in Counter(names).items() if k > 1]
    if twice:
        raise ValueError(f"{what} names must be unique: {', '.join(map(str, twice))}")


def _listed(value, allowed: list[str], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what}: {value!r} is none of {', '.join(allowed)}")
    return value


def seed_rows(data: dict) -> list[dict]:
    """The seeds with defaults filled in. No URL, an unknown campus or level, a malformed term or a name that occurs
    twice raises."""
    out = []
    for n, raw in enumerate(data.get("seeds") or [], 1):
        given = {k: v for k, v in raw.items() if v is not None}
        name = given.get("name") or f"seed-{n}"
        if not given.get("url"):
            raise ValueError(f"seed {name}: no url")
        row = {"name": name, "url": given["url"], **{k: type(d)(given.get(k, d)) for k, d in SEED_DEFAULTS.items()}}
        _listed(row["campus"], DOCUMENT_CAMPUSES, f"seed {name}")
        _listed(row["academic_level"], DOCUMENT_LEVELS, f"seed {name}")
        if row["term"] != EVERGREEN and not re.match(TERM, row["term"].strip()):
            raise ValueError(f"seed {name}: malformed term {row['term']!r}")
        out.append(row)
    _once([r["name"] for r in out], "seed")
    return out


def chosen_seeds(rows: list[dict], only: list[str] | None) -> list[dict]:
    """The seeds named, in their own order; an unknown name raises."""
    unknown = sorted(set(only or []) - {r["name"] for r in rows})
    if unknown:
        raise ValueError(f"unknown seeds: {', '.join(unknown)}")
    return [r for r in rows if r["name"] in only] if only else rows


def contact_rows(data: dict) -> list[dict]:
    """The contacts, topics trimmed and in lower case. A blank name or contact method, an unknown campus or a name that
    occurs twice raises."""
    out = []
    for n, raw in enumerate(data.get("contacts") or [], 1):
        for field in ("name", "contact_method"):
            if not str(raw.get(field) or "").strip():
                raise ValueError(f"contact {n}: no {field}")
        if raw.get("campus") is not None:
            _listed(raw["campus"], CONTACT_CAMPUSES, f"contact {n}")
        out.append({"name": raw["name"], "topics": [str(t).strip().lower() for t in raw.get("topics") or []], "contact_method": raw["contact_method"], "campus": raw.get("campus")})
    _once([r["name"] for r in out], "contact")
    return out


def as_table(spark: SparkSession, rows: list[dict], table: str) -> DataFrame:
    """Checked rows as a table of its fixed schema."""
    schema = spark.createDataFrame([], SCHEMAS[table]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
