"""Rule files: dictionaries with includes, mappings, families, phrases, settings; read on the driver, they are small."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STRIPPED = "’' \""


def entries(path: str | Path, comments: bool = True, missing_ok: bool = False, seen: frozenset[Path] = frozenset()) -> list[tuple[str, str]]:
    """(entry, file) of a dictionary file; "#include other" reads another file, each once; "#" starts a comment line."""
    p = Path(path).resolve()
    if p in seen:
        return []
    if not p.exists():
        if missing_ok:
            return []
        raise FileNotFoundError(f"dictionary not found: {p}")
    out: list[tuple[str, str]] = []
    for raw in p.read_text(encoding="utf-8").splitlines():
        word = raw.strip()
        if comments and word.lower().startswith("#include "):
            out += entries(p.parent / word[9:].strip(), comments, missing_ok, seen | {p})
        elif word and not (comments and word.startswith("#")):
            out.append((word, p.name))
    return out


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def lexicon(spark: SparkSession, *paths: str | Path, folded: bool = False, **how) -> DataFrame:
    """lexicon(word, source) of all files; folded strips quotes and lower-cases."""
    rows = [(w.strip(STRIPPED).lower() if folded else w, f) for p in paths for w, f in entries(p, **how)]
    return _frame(spark, rows, "word string, source string").distinct()


def repeatable(spark: SparkSession, path: str | Path) -> DataFrame:
    """lexicon(word, source) of every non-blank line in lower case; includes and comments are entries like others."""
    return _frame(spark, [(w.lower(), f) for w, f in entries(path, comments=False)], "word string, source string").distinct()


def system_words(spark: SparkSession, path: str | Path = "/usr/share/dict/words") -> DataFrame:
    """lexicon(word, source) of the system's word list in lower case; empty where there is none."""
    return _frame(spark, [(w.lower(), f) for w, f in entries(path, comments=False, missing_ok=True)], "word string, source string").distinct()


def accepted_lines(spark: SparkSession, path: str | Path) -> DataFrame:
    """accepted(line): the stripped, non-blank lines of a file that may be missing."""
    return _frame(spark, sorted({(w,) for w, _ in entries(path, comments=False, missing_ok=True)}), "line string")


def allow_file(spark: SparkSession, path: str | Path | None) -> DataFrame:
    """lexicon(word, source) of a file of allowed words: none without a path, and an error if the named file is missing."""
    return lexicon(spark, path) if path else _frame(spark, [], "word string, source string")


def flag_words(spark: SparkSession, path: str | Path) -> DataFrame:
    """flag_words(wrong_lower, right) of lines "wrong => right"; a later line for the same word wins."""
    found = {}
    for line, _ in entries(path):
        wrong, arrow, right = line.partition("=>")
        if arrow and wrong.strip():
            found[wrong.strip().lower()] = right.strip()
    return _frame(spark, list(found.items()), "wrong_lower string, right string")


def families(spark: SparkSession, path: str | Path) -> DataFrame:
    """families(family, ordinal, alts) of lines "preferred <= a, b"; malformed lines are left out."""
    found: dict[str, tuple] = {}
    for i, (line, _) in enumerate(entries(path)):
        preferred, arrow, alts = line.partition("<=")
        names = [a.strip() for a in alts.split(",") if a.strip()]
        if arrow and preferred.strip() and names:
            found[preferred.strip().lower()] = (preferred.strip(), i, names)
    return _frame(spark, list(found.values()), "family string, ordinal int, alts array<string>")


def phrases(spark: SparkSession, path: str | Path, comments: bool = True) -> DataFrame:
    """phrases(phrase, ordinal) of non-blank lines."""
    return _frame(spark, [(w, i) for i, (w, _) in enumerate(entries(path, comments, missing_ok=True))], "phrase string, ordinal int")


def suppressions(spark: SparkSession, *paths: str | Path) -> tuple[DataFrame, DataFrame]:
    """(disabled rules (rule), ignored phrases (phrase)): upper-case lines name rules."""
    lines = {x.strip() for p in paths if Path(p).exists() for x in Path(p).read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")}
    return _frame(spark, [(x,) for x in lines if x.isupper()], "rule string"), _frame(spark, [(x,) for x in lines if not x.isupper()], "phrase string")


def resolve(name: str, book: str | Path, root: str | Path) -> Path:
    """A rule file's place: absolute, else in the book's folder, else below the root."""
    p = Path(name)
    if p.is_absolute():
        return p
    return Path(book) / p if (Path(book) / p).exists() else Path(root) / p


def merged(base: dict, over: dict) -> dict:
    """base with over on top; dicts merge, all else is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def settings(path: str | Path, local: str | Path | None = None) -> dict:
    """YAML settings with a local file on top."""
    import yaml

    out = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if local and Path(local).exists():
        out = merged(out, yaml.safe_load(Path(local).read_text(encoding="utf-8")) or {})
    return out


def books(root: str | Path) -> list[Path]:
    """Folders with a manuscript somewhere in them, else the examples."""
    root = Path(root)
    found = sorted(d for d in root.iterdir() if d.is_dir() and any(d.rglob("*.docx")))
    return found or sorted(d for d in (root / "example").glob("*") if d.is_dir())


def manuscript(book: str | Path) -> Path:
    """The folder's one manuscript."""
    found = [p for p in sorted(Path(book).glob("*.docx")) if p.name != "fake.docx"]
    if len(found) != 1:
        raise ValueError(f"{book}: {len(found)} manuscripts, one is needed")
    return found[0]
