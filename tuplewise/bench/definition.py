"""Benchmark definitions: the YAML schema, its rules, discovery, and the cache of generated ones."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import yaml

from ..errors import BenchmarkInvalid, BenchmarkNotFound, SpecDrift

ONTOLOGY = "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl"
#: Generator parameters and their defaults.
GENERATORS = {
    "lubm": {"scale": None, "seed": 0, "threads": 1, "start_index": 0, "ontology": ONTOLOGY, "queries": None},
    "watdiv": {"scale": None, "seed": 0, "stress": {"max_query_size": 5, "query_count": 20, "constants_per_query": 2, "allow_join_vertex": False}},
}


@dataclass
class Definition:
    name: str
    description: str = ""
    #: Each with name and url.
    relations: list[dict] = field(default_factory=list)
    #: Each with name, description and query.
    queries: list[dict] = field(default_factory=list)
    generator: dict | None = None

    @classmethod
    def load(cls, path: str | Path) -> Definition:
        try:
            raw = yaml.safe_load(Path(path).read_text())
        except yaml.YAMLError as e:
            raise BenchmarkInvalid(f"{path}: {e}") from e
        if not isinstance(raw, dict) or not isinstance(raw.get("name"), str):
            raise BenchmarkInvalid(f"{path}: no name")
        made = cls(raw["name"], str(raw.get("description") or ""), list(raw.get("relations") or []), list(raw.get("queries") or []), raw.get("generator"))
        made.validate()
        return made

    def fail(self, reason: str) -> None:
        raise BenchmarkInvalid(f"benchmark {self.name!r}: {reason}")

    def validate(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.name) or self.name in (".", ".."):
            self.fail("the name may hold letters, digits, '.', '_' and '-' only")
        static = bool(self.relations or self.queries)
        if static == bool(self.generator):
            self.fail("either a generator or relations and queries, not both and not neither")
        if self.generator:
            self._validate_generator()
            return
        for kind, entries, keys in (("relation", self.relations, ("name", "url")), ("query", self.queries, ("name", "query"))):
            if not entries:
                self.fail(f"no {kind}")
            seen = set()
            for e in entries:
                for k in keys:
                    if not e.get(k):
                        self.fail(f"a {kind} without {k}")
                if e["name"] in seen:
                    self.fail(f"{kind} {e['name']!r} twice")
                seen.add(e["name"])

    def _validate_generator(self) -> None:
        spec = self.full_spec()
        if not isinstance(spec["scale"], int) or isinstance(spec["scale"], bool) or spec["scale"] < 1:
            self.fail("the scale must be 1 or more")
        if spec["kind"] == "lubm":
            if not spec["ontology"]:
                self.fail("an empty ontology")
            names = spec["queries"]
            if names is not None:
                if not names or len(set(names)) != len(names):
                    self.fail("an empty list of queries, or one twice")
                for q in names:
                    if not re.fullmatch(r"q([1-9]|1[0-4])", str(q)):
                        self.fail(f"{q!r} isn't one of q1 to q14")

    def full_spec(self) -> dict:
        """The generator with all defaults, keys in a fixed order."""
        given = dict(self.generator or {})
        kind = given.pop("kind", None)
        if kind not in GENERATORS:
            self.fail(f"unknown generator {kind!r}")
        spec = {"kind": kind}
        for key, default in GENERATORS[kind].items():
            value = given.pop(key, default)
            if isinstance(default, dict):
                extra = set(value or {}) - set(default)
                if extra:
                    self.fail(f"unknown {key} parameters {sorted(extra)}")
                value = {**default, **(value or {})}
            spec[key] = value
        if given:
            self.fail(f"unknown generator parameters {sorted(given)}")
        return spec

    def spec_hash(self) -> str:
        return hashlib.sha256(yaml.safe_dump(self.full_spec(), sort_keys=False).encode()).hexdigest()

    def to_yaml(self) -> str:
        return yaml.safe_dump({k: v for k, v in asdict(self).items() if v or k in ("name", "description")}, sort_keys=False, width=1000)


def discover(workspace: str | Path, cache: str | Path | None = None) -> dict[str, tuple[Definition, str]]:
    """Definitions by name, sorted, each with where it is from. A file's stem is its benchmark's name; a generated one in the
    cache (a folder with benchmark.yml and meta.json) comes before one of the workspace."""
    found: dict[str, tuple[Definition, str]] = {}
    for p in sorted(Path(workspace).glob("*.yml")) if Path(workspace).is_dir() else []:
        d = Definition.load(p)
        if d.name != p.stem:
            raise BenchmarkInvalid(f"{p}: the name {d.name!r} isn't the file's")
        found[d.name] = (d, "workspace")
    if cache and Path(cache).is_dir():
        for p in sorted(Path(cache).iterdir()):
            if (p / "benchmark.yml").exists() and (p / "meta.json").exists():
                d = Definition.load(p / "benchmark.yml")
                found[d.name] = (d, "cache")
    return dict(sorted(found.items()))


def find(name: str, workspace: str | Path, cache: str | Path | None = None) -> Definition:
    found = discover(workspace, cache)
    if name not in found:
        raise BenchmarkNotFound(f"no benchmark {name!r}")
    return found[name][0]


def check_tag(tag: str, workspace: str | Path) -> None:
    """A tag for generated data: not all digits, and no name of the workspace."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", tag) or tag.isdigit():
        raise BenchmarkInvalid(f"tag {tag!r} needs a character that isn't a digit")
    if tag in discover(workspace):
        raise BenchmarkInvalid(f"tag {tag!r} is the name of a benchmark")


def local_path(url: str) -> str | None:
    """The path of a file:// URL or a plain path; None for http(s)."""
    if url.startswith("file://"):
        return url[7:]
    return None if re.match(r"https?://", url) else url


def ensure_cached(definition: Definition, cache: str | Path) -> dict[str, str]:
    """A path for each relation; http(s) files are downloaded once, under a temporary name until they are whole."""
    out = {}
    for r in definition.relations:
        path = local_path(r["url"])
        if path is None:
            target = Path(cache) / definition.name / f"{r['name']}{Path(r['url']).suffix or '.parquet'}"
            if not target.exists():
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_suffix(target.suffix + ".part")
                with urllib.request.urlopen(r["url"], timeout=60) as src, part.open("wb") as dst:
                    shutil.copyfileobj(src, dst)
                part.rename(target)
            path = str(target)
        out[r["name"]] = path
    return out


def status(definition: Definition, cache: str | Path) -> str:
    """cached, not cached, not generated or stale."""
    if definition.generator:
        meta = Path(cache) / definition.name / "meta.json"
        if not meta.exists():
            return "not generated"
        return "cached" if json.loads(meta.read_text()).get("spec_hash") == definition.spec_hash() else "stale"
    there = [Path(p) if (p := local_path(r["url"])) else Path(cache) / definition.name / f"{r['name']}{Path(r['url']).suffix or '.parquet'}" for r in definition.relations]
    return "cached" if all(p.exists() for p in there) else "not cached"


def clean(name: str, cache: str | Path) -> bool:
    folder = Path(cache) / name
    if not folder.is_dir():
        return False
    shutil.rmtree(folder)
    return True


def materialize(definition: Definition, cache: str | Path, generate: Callable[[Definition, Path], dict], force: bool = False) -> Definition:
    """A definition with relations and queries. What a generator made is used again if its specification is the same;
    if it differs (or isn't recorded) that is an error, unless force makes it anew."""
    if not definition.generator:
        return definition
    folder = Path(cache) / definition.name
    meta = folder / "meta.json"
    if meta.exists():
        same = json.loads(meta.read_text()).get("spec_hash") == definition.spec_hash()
        if same and not force:
            return Definition.load(folder / "benchmark.yml")
        if not same and not force:
            raise SpecDrift(f"{definition.name} was generated from another specification; force it to make it anew")
    if folder.exists():
        shutil.rmtree(folder)
    about = generate(definition, folder)
    meta.write_text(json.dumps({**about, "spec_hash": definition.spec_hash()}, indent=2, sort_keys=True))
    return Definition.load(folder / "benchmark.yml")
