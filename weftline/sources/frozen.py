"""Frozen tables: data, then a manifest of counts and digests, checked whenever they are read; vectors; run configuration."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.files import collection_digest, read_text, write_json

MANIFEST = "manifest.json"


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice in a JSON object")
    return out


def _no_constant(x: str) -> float:
    raise ValueError(f"{x} is not JSON")


def parse_json(text: str) -> object:
    """Strict JSON: no repeated keys, no NaN or infinities."""
    return json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_no_repeats, parse_constant=_no_constant)


def read_json(spark: SparkSession, path: str) -> object:
    return parse_json(read_text(spark, path))


def fingerprint(value: object, without: Sequence[str] = ()) -> str:
    """SHA-256 of canonical JSON of a value, without the named top-level keys (secrets, addresses): equal settings, equal name."""
    if isinstance(value, Mapping):
        value = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def run_settings(given: Mapping[str, object], environment: Mapping[str, str], prompts: Mapping[str, str]) -> dict:
    """Checked settings of a labelling run with their version.

    given: model, task, one of prompt (text) and prompt_name (a key of prompts), repeats, max_attempts, timeout_seconds,
    max_input_chars; and key_variable, the name of the environment variable that holds the secret. The secret itself is never
    part of the version. Unknown names, both or no prompt, and numbers out of range are errors.
    """
    known = {"model", "task", "prompt", "prompt_name", "repeats", "max_attempts", "timeout_seconds", "max_input_chars", "key_variable"}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if ("prompt" in given) == ("prompt_name" in given):
        raise ValueError("give prompt or prompt_name, not both")
    if "prompt_name" in given and given["prompt_name"] not in prompts:
        raise ValueError(f"unknown prompt {given['prompt_name']!r}")
    out = {"repeats": 2, "max_attempts": 3, "timeout_seconds": 60.0, "max_input_chars": 100_000, **given}
    out["prompt"] = given.get("prompt") or prompts[given["prompt_name"]]
    for name in ("model", "task", "prompt"):
        if not isinstance(out.get(name), str) or not out[name].strip():
            raise ValueError(f"{name} is missing")
    for name, top in (("repeats", 10), ("max_attempts", 10), ("timeout_seconds", 3600), ("max_input_chars", 10_000_000)):
        if isinstance(out[name], bool) or not isinstance(out[name], (int, float)) or not math.isfinite(out[name]) or not 0 < out[name] <= top:
            raise ValueError(f"{name} lies above 0 and at most at {top}")
    variable = out.get("key_variable")
    out["secret"] = environment.get(str(variable)) if variable else None
    out["version"] = fingerprint(out, without=("secret", "key_variable", "prompt_name", "timeout_seconds", "max_attempts", "version"))
    return out


def freeze(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str, extra: Mapping[str, object] | None = None) -> dict:
    """Write tables (name: (data, order columns)) as Parquet below path and then the manifest with rows, schema and digest of each.

    The manifest comes last, so a folder without one is unfinished. It has a digest of its own over everything else in it.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    entry = {}
    for name, (df, order) in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        r = collection_digest(spark.read.schema(df.schema).parquet(f"{path}/{name}"), list(order)).first()
        entry[name] = {"rows": r["rows"], "digest": r["digest"], "order": list(order), "schema": df.schema.simpleString()}
    manifest = {"tables": entry, **(extra or {})}
    manifest["manifest_digest"] = fingerprint(manifest)
    write_json(spark, f"{path}/{MANIFEST}", manifest)
    return manifest


def checked_manifest(spark: SparkSession, path: str, expect: Mapping[str, object] | None = None) -> dict:
    """The manifest of a frozen folder; it must be whole and agree with the expected entries (a policy id, another folder's digest)."""
    m = read_json(spark, f"{path}/{MANIFEST}")
    if fingerprint(m, without=("manifest_digest",)) != m.get("manifest_digest"):
        raise ValueError("the manifest was changed")
    if wrong := {k: m.get(k) for k, v in (expect or {}).items() if m.get(k) != v}:
        raise ValueError(f"another study: {wrong}")
    return m


def load_frozen(spark: SparkSession, path: str, name: str, expect: Mapping[str, object] | None = None) -> DataFrame:
    """A frozen table whose rows still have the digest of the manifest."""
    e = checked_manifest(spark, path, expect)["tables"][name]
    df = spark.read.parquet(f"{path}/{name}")
    r = collection_digest(df, e["order"]).first()
    if (r["rows"], r["digest"]) != (e["rows"], e["digest"]):
        raise ValueError(f"table {name} was changed")
    return df


def write_vectors(df: DataFrame, path: str, encoder: str) -> dict:
    """Vectors (input_id, vector) under the name of their encoder; repeated ids are an error."""
    if df.groupBy("input_id").count().filter("count > 1").take(1):
        raise ValueError("an input has several vectors")
    return freeze({"vectors": (df.select("input_id", "vector"), ["input_id"])}, path, {"encoder": encoder})


def read_vectors(spark: SparkSession, path: str, inputs: DataFrame, encoder: str) -> DataFrame:
    """inputs with their vectors, by id; another encoder, changed rows or a missing vector are errors."""
    v = load_frozen(spark, path, "vectors", {"encoder": encoder})
    out = aligned(inputs, v)
    if missing := out.filter("vector IS NULL").select("input_id").take(3):
        raise ValueError(f"no vector for {[r['input_id'] for r in missing]}")
    return out


def aligned(inputs: DataFrame, vectors: DataFrame) -> DataFrame:
    """inputs with the vector of the same input_id, null where there is none."""
    return inputs.join(vectors.select("input_id", "vector"), "input_id", "left")


def markdown(title: str, sections: Mapping[str, DataFrame | str], limit: int = 50) -> str:
    """A report of small result tables: each section is text or a table of at most `limit` rows, the rest is counted. Floats have four digits."""

    def cell(v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, float):
            return "" if math.isnan(v) else f"{v:.4f}"
        return str(v).replace("|", "\\|").replace("\n", " ")

    out = [f"# {title}", ""]
    for name, x in sections.items():
        out += [f"## {name}", ""]
        if isinstance(x, str):
            out += [x, ""]
            continue
        rows = x.limit(limit + 1).collect()
        out += ["| " + " | ".join(x.columns) + " |", "|" + "-|" * len(x.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
        out += [f"\n{x.count() - limit} more rows." if len(rows) > limit else "", ""]
    return "\n".join(out).rstrip() + "\n"
