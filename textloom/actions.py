"""What the command line runs: script -> action -> name -> function.

Built-in actions are the functions registered here. A project adds its own as modules
`{root}/actions/{script}/{action}/{name}.py` (or `{action}/__init__.py`) with a `main`. A function gets
the arguments it names: spark, config, dirs, log, the sections of the configuration, and its flat keys.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from textloom import config as conf

REGISTRY: dict[tuple[str, str, str | None], Callable[..., Any]] = {}
#: Fields of the sections of a configuration that may also stand at its top level.
SECTIONS = {
    "data": {"dataset_name", "dataset_src_start", "dataset_src_end", "dataset_src_query", "ratios", "seed", "langs", "urls", "roots"},
    "model": {"model_name", "model_short", "max_seq_length"},
    "train": {"batch", "lr", "epochs"},
}


def action(script: str, name: str, sub: str | None = None):
    def register(f: Callable[..., Any]) -> Callable[..., Any]:
        REGISTRY[(script, name, sub)] = f
        return f

    return register


def _modules(root: Path) -> dict[tuple[str, str, str | None], Path]:
    found = {}
    for p in sorted((root / "actions").glob("*/*/*.py")):
        found[(p.parts[-3], p.parts[-2], None if p.stem == "__init__" else p.stem)] = p
    for p in sorted((root / "actions").glob("*/*/*/__init__.py")):
        found[(p.parts[-4], p.parts[-3], p.parts[-2])] = p
    return found


def tree(root: Path) -> dict[str, dict[str, list[str]]]:
    """script -> action -> names, of what is built in and what the project adds, sorted."""
    out: dict[str, dict[str, set[str]]] = {}
    for script, act, name in [*REGISTRY, *_modules(root)]:
        names = out.setdefault(script, {}).setdefault(act, set())
        if name:
            names.add(name)
    return {s: {a: sorted(n) for a, n in sorted(acts.items())} for s, acts in sorted(out.items())}


def resolve(root: Path, script: str, act: str, name: str | None) -> Callable[..., Any]:
    """The function of an action: the project's own before the built-in one."""
    path = _modules(root).get((script, act, name))
    if path is not None:
        spec = importlib.util.spec_from_file_location(f"textloom_actions_{script}_{act}_{name or 'main'}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if callable(getattr(module, "main", None)):
            return module.main
    if (script, act, name) in REGISTRY:
        return REGISTRY[(script, act, name)]
    raise LookupError(f"nothing to run for {script} {act} {name or ''}".rstrip())


def call(f: Callable[..., Any], values: dict[str, Any]) -> Any:
    """f with those of the values that it names; one that it needs and that is missing is an error."""
    wanted = inspect.signature(f).parameters
    missing = [n for n, p in wanted.items() if p.default is p.empty and n not in values and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]
    if missing:
        raise ValueError(f"the configuration lacks {', '.join(missing)}")
    return f(**{k: v for k, v in values.items() if k in wanted})


def run(root: Path, script: str, act: str, name: str | None, extra: tuple[str, ...], spark: Callable[[], SparkSession]) -> Any:
    """Run an action under its merged configuration."""
    f = resolve(root, script, act, name)
    merged = conf.stacked(root / "conf", script, act, name, extra)
    sections = conf.route(merged, SECTIONS)
    dirs = conf.run_dirs(root, act, name)
    log = conf.logger(name or act, dirs["base"]["log"])
    values = {**sections["extra"], **sections["data"], **{k: v for k, v in sections.items() if k != "extra"}, "config": merged, "dirs": dirs, "log": log}
    if "spark" in inspect.signature(f).parameters:
        values["spark"] = spark()
    log.info("%s %s %s", script, act, name or "")
    return call(f, values)


# ---- built in


def _spec(dataset_src_start: str, dataset_src_end: str):
    from textloom.plans.datasets import ScanSpec

    return ScanSpec(str(dataset_src_start), str(dataset_src_end))


def _articles(spark: SparkSession, path: str):
    from textloom import schemas

    return spark.read.schema(schemas.ARTICLE).json(path)


@action("data", "create", "keywords")
def create_keywords(spark, articles: str, out: str, categories: dict, dataset_src_start: str, dataset_src_end: str, rows_per_file: int = 50_000):
    """Articles with a keyword of a category, as rolling CSV and JSON files."""
    from textloom.plans.datasets import keyword_articles
    from textloom.sinks.writers import write_articles

    write_articles(keyword_articles(_articles(spark, articles), _spec(dataset_src_start, dataset_src_end), categories), out, rows_per_file, ["created", "uuid"])


@action("data", "create", "patterns")
def create_by_patterns(spark, articles: str, out: str, patterns: str, dataset_src_start: str, dataset_src_end: str, rows_per_file: int = 50_000):
    """Articles with a keyword or expression of a table of them (Parquet), as rolling CSV and JSON files."""
    from textloom.plans.datasets import articles_by_table
    from textloom.sinks.writers import write_articles

    write_articles(articles_by_table(_articles(spark, articles), _spec(dataset_src_start, dataset_src_end), spark.read.parquet(patterns)), out, rows_per_file, ["created", "uuid"])


@action("data", "create", "companies")
def create_companies(spark, articles: str, out: str, dataset_src_query: dict, dataset_src_start: str, dataset_src_end: str, rows_per_file: int = 10_000):
    """Articles of companies by keywords and expressions, as rolling CSV and JSON files."""
    from textloom.plans.datasets import CompanySpec, company_articles
    from textloom.sinks.writers import write_articles

    matches = dataset_src_query.get("industry_match") or {}
    company = CompanySpec(dataset_src_query.get("industry_map") or {}, {k: v["keywords"] for k, v in matches.items() if "keywords" in v}, {k: v["expressions"] for k, v in matches.items() if "expressions" in v})
    write_articles(company_articles(_articles(spark, articles), _spec(dataset_src_start, dataset_src_end), company), out, rows_per_file, ["created", "uuid"])


@action("data", "download", "archives")
def download_files(urls: list, out: str, password: str | None = None):
    """Stage files; zip archives are unpacked."""
    from textloom.sources.records import download, download_archives

    zips = [u for u in urls if u.split("?")[0].endswith(".zip")]
    return [*download_archives(zips, Path(out), password), *download([u for u in urls if u not in zips], Path(out))]


@action("data", "fetch", "archives")
def fetch_files(spark, urls: list, out: str, again: bool = False):
    """Stage files by the executors in a folder of the shared store, which keeps zip archives as they are; `zip_members` reads them."""
    from textloom.sources.store import fetch

    return fetch(spark.createDataFrame([(u,) for u in urls], "url string"), out, again=again)  # as many as the configuration names


@action("data", "prepare", "ner")
def prepare_ner(spark, roots: dict, out: str):
    """Annotated corpora as sentence files per language."""
    from textloom.plans.corpus import prepare
    from textloom.sinks.writers import write_sentences

    write_sentences(prepare(spark, roots), out)


@action("data", "split", "ner")
def split_ner(spark, prepared: str, out: str, ratios: list = (0.8, 0.1, 0.1), seed: int = 2611):
    """Prepared sentences with a split, as files per language and split."""
    from textloom.plans.corpus import split
    from textloom.sinks.writers import write_sentences
    from textloom.sources.records import prepared_sentences

    write_sentences(split(prepared_sentences(spark, prepared).drop("split"), tuple(ratios), seed), out)


@action("data", "analyze", "ner")
def analyze_ner(spark, splits: str, out: str, log):
    """Sentence, token and label counts per language, and per language and split."""
    from textloom.operators.stats import label_stats, tags, text_table
    from textloom.sinks.writers import write_stats
    from textloom.sources.records import prepared_sentences

    sentences = prepared_sentences(spark, splits)
    columns = tags(sentences)
    for name, by in (("base", ["lang"]), ("splits", ["lang", "split"])):
        table = label_stats(sentences, by, columns).orderBy(*by)
        write_stats(table, f"{out}/{name}")
        for line in text_table(table):
            log.info(line)


@action("query", "run")
def run_query(spark, query: str, tables: str, out: str | None = None):
    """A registered query over a folder of tables: shown, or written to out."""
    import textloom.queries_tables  # noqa: F401  registers its queries, and those of the modules it imports
    from textloom.registry import QUERIES

    df = QUERIES[query](spark, tables)
    if out:
        df.write.mode("overwrite").parquet(out)
    else:
        df.show(20, truncate=80)
