"""Settings of a project, from the small part of YAML that ``config.yaml`` uses."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from textquarry.model import MAX_CHARS, OVERLAP_CHARS, TOP_K


@dataclass(frozen=True)
class Settings:
    root: str
    corpus: str = "corpus"
    data: str = "data"
    max_chars: int = MAX_CHARS
    overlap_chars: int = OVERLAP_CHARS
    top_k: int = TOP_K


def project_root(start: str | Path = ".") -> Path:
    """The nearest folder at or above ``start`` that holds a settings file or a git repository."""
    here = Path(start).resolve()
    marked = (p for p in (here, *here.parents) if (p / "config.yaml").exists() or (p / ".git").exists())
    return next(marked, here)


def parse(text: str) -> dict[tuple[str, str], str]:
    """{(section, key): value}: sections and plain values; comments only on lines of their own."""
    out: dict[tuple[str, str], str] = {}
    section = ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            continue
        name, colon, value = line.partition(":")
        if colon and not value and not line.startswith("-"):
            section = name.strip()
        elif colon:
            out[section, name.strip()] = value.strip().strip("'\"")
    return out


def load(start: str | Path = ".") -> Settings:
    root = project_root(start)
    path = root / "config.yaml"
    v = parse(path.read_text(encoding="utf-8")) if path.exists() else {}
    return Settings(
        str(root),
        v.get(("paths", "corpus_dir"), "corpus"),
        v.get(("paths", "data_dir"), "data"),
        int(v.get(("chunking", "max_chars"), MAX_CHARS)),
        int(v.get(("chunking", "overlap_chars"), OVERLAP_CHARS)),
        int(v.get(("search", "default_top_k"), TOP_K)),
    )
