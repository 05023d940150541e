"""A profile (YAML or JSON) as small tables: bands, funding stages, items, queries, rules, red flags.

The file is read on the driver, checked, and becomes dimension tables that every operator joins with."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Lists of a profile and the keys that their entries must have.
REQUIRED = {
    "stages": ("id", "label", "min_headcount"),
    "funding_stages": ("id", "label"),
    "startup_guidance_sources": ("id", "title", "url"),
    "startup_guidance_rules": ("id",),
    "expectations": ("id", "area", "claim", "severity_if_missing"),
    "red_flags": ("id", "area", "pattern", "severity"),
}
SEVERITIES = ("low", "medium", "high", "critical")
PREFIX = "EVISPARK_"


@dataclass(frozen=True)
class Options:
    """What a run can be told, with what it does if it isn't; ``from_environment`` reads EVISPARK_ names."""

    chunk_chars: int = 5200
    chunk_overlap: int = 480
    chunk_mode: str = "legacy"
    snippets_per_item: int = 6
    snippet_chars: int = 900
    urls_per_host: int = 8
    most_urls: int = 60
    directory_top: int = 8
    provisional_below: float = 0.62

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> "Options":
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            if (raw := env.get(PREFIX + f.name.upper())) is not None:
                try:
                    found[f.name] = type(f.default)(raw)
                except ValueError:
                    continue  # what can't be read leaves the default
        made = cls(**found)
        return cls(**(found | {"chunk_chars": max(800, made.chunk_chars), "chunk_overlap": max(80, made.chunk_overlap)}))


def environment_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file, quotes and comments dropped; empty if there is none."""
    out = {}
    if os.path.exists(path):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out


@dataclass
class Profile:
    name: str
    entries: dict[str, list[dict]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str | Path) -> "Profile":
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(path)
        text = path.read_text(encoding="utf-8")
        if path.suffix.lower() in (".yaml", ".yml"):
            import yaml

            found = yaml.safe_load(text)
        elif path.suffix.lower() == ".json":
            found = json.loads(text)
        else:
            raise ValueError(f"{path.name}: a profile is YAML or JSON")
        if not isinstance(found, dict):
            raise ValueError("a profile is a mapping")
        made = cls(str(found.get("name", path.stem)), {k: list(found.get(k) or []) for k in REQUIRED})
        if wrong := made.problems():
            raise ValueError("; ".join(wrong))
        return made

    def problems(self) -> list[str]:
        """Missing keys, ids that repeat, and references to nothing."""
        out, ids = [], {}
        for kind, keys in REQUIRED.items():
            seen: set[str] = set()
            for i, entry in enumerate(self.entries.get(kind, [])):
                if missing := [k for k in keys if k not in entry]:
                    out.append(f"{kind}[{i}] lacks {', '.join(missing)}")
                elif entry["id"] in seen:
                    out.append(f"{kind}: {entry['id']} repeats")
                seen.add(entry.get("id"))
            ids[kind] = seen

        def refer(kind: str, key: str, target: str) -> None:
            for entry in self.entries.get(kind, []):
                out.extend(f"{kind} {entry.get('id')}: {x} is in no {target}" for x in entry.get(key) or [] if x not in ids[target])

        refer("stages", "expectations", "expectations")
        refer("startup_guidance_rules", "size_stage_ids", "stages")
        refer("startup_guidance_rules", "funding_stage_ids", "funding_stages")
        refer("startup_guidance_rules", "source_ids", "startup_guidance_sources")
        for kind, key in (("expectations", "severity_if_missing"), ("red_flags", "severity")):
            out += [f"{kind} {e.get('id')}: severity {e[key]}" for e in self.entries.get(kind, []) if e.get(key) is not None and e[key] not in SEVERITIES]
        for stage in self.entries.get("stages", []):
            if stage.get("max_headcount") is not None and stage["max_headcount"] < stage.get("min_headcount", 0):
                out.append(f"stages {stage['id']}: ends before it starts")
        return out

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The dimension tables, all small: bands, band_items, funding_aliases, items, queries, item_fields,
        rules, rule_lines, sources, red_flags."""
        e = self.entries
        stages = sorted(e["stages"], key=lambda s: s["min_headcount"])
        rows = {
            "bands": ([(s["id"], s["min_headcount"], s.get("max_headcount"), i) for i, s in enumerate(stages, 1)], "band string, lo int, hi int, ord int"),
            "band_items": ([(s["id"], i, x) for s in stages for i, x in enumerate(s.get("expectations") or [])], "band string, ord int, item_id string"),
            "funding_aliases": ([(s["id"], s["label"], a, i) for i, s in enumerate(e["funding_stages"]) for a in s.get("aliases") or []], "stage string, label string, alias string, ord int"),
            "items": ([(x["id"], i, x["area"], x["claim"], x["severity_if_missing"], bool(x.get("compliance")), x.get("follow_up_question") or "") for i, x in enumerate(e["expectations"])], "item_id string, ord int, area string, claim string, severity string, compliance boolean, question string"),
            "queries": ([(x["id"], i, q) for x in e["expectations"] for i, q in enumerate(dict.fromkeys([*(x.get("evidence_queries") or []), x["claim"]]))], "item_id string, q int, query string"),
            "item_fields": ([(x["id"], f) for x in e["expectations"] for f in x.get("snapshot_fields") or []], "item_id string, field string"),
            "rules": ([(r["id"], i, r.get("size_stage_ids") or [], r.get("funding_stage_ids") or []) for i, r in enumerate(e["startup_guidance_rules"])], "rule string, ord int, sizes array<string>, funds array<string>"),
            "rule_lines": ([(r["id"], kind, i, x) for r in e["startup_guidance_rules"] for kind, key in (("practice", "recommended_practices"), ("risk", "potential_risks"), ("source", "source_ids")) for i, x in enumerate(r.get(key) or [])], "rule string, kind string, pos int, text string"),
            "sources": ([(s["id"], i, s["title"]) for i, s in enumerate(e["startup_guidance_sources"], 1)], "source string, ord int, title string"),
            "red_flags": ([(r["id"], r["area"], r["severity"], r["pattern"], bool(r.get("regex"))) for r in e["red_flags"]], "rule string, area string, severity string, pattern string, regex boolean"),
        }
        return {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot file (JSON: field -> value) in long form: field, value."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))

    def flat(value, name: str) -> list[tuple[str, str]]:
        if isinstance(value, dict):
            return [row for k, v in value.items() for row in flat(v, f"{name}.{k}" if name else k)]
        return [] if value is None else [(name, value if isinstance(value, str) else json.dumps(value))]

    return spark.createDataFrame(flat(found, ""), "field string, value string")
