"""Settings of an index: checked on the driver, saved as JSON, overridden by the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from corpusloom.sources.formats import READERS, SCANNED, Limits

PREFIX = "CORPUSLOOM_"


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1200
    chunk_overlap: int = 150
    structure_max_chars: int = 2000
    chunk_strategy: str = "structure"
    rerank_top_n: int = 30
    extensions: tuple[str, ...] = tuple(sorted((*READERS, *SCANNED)))
    excluded: tuple[str, ...] = (".git", "node_modules", "__pycache__")
    max_text_bytes: int = Limits.text
    max_archive_entries: int = Limits.entries
    max_archive_bytes: int = Limits.total
    max_json_values: int = Limits.leaves
    max_csv_rows: int = Limits.rows

    def __post_init__(self) -> None:
        rules = {
            "chunk_chars must be 100 at least": self.chunk_chars >= 100,
            "chunk_overlap must be below chunk_chars": 0 <= self.chunk_overlap < self.chunk_chars,
            "structure_max_chars must be 200 at least": self.structure_max_chars >= 200,
            "chunk_strategy is structure or window": self.chunk_strategy in ("structure", "window"),
            "rerank_top_n is from 1 to 200": 1 <= self.rerank_top_n <= 200,
            "extensions start with a dot": all(e.startswith(".") for e in self.extensions),
        }
        if broken := [text for text, holds in rules.items() if not holds]:
            raise ValueError("; ".join(broken))

    @property
    def limits(self) -> Limits:
        return Limits(self.max_text_bytes, self.max_archive_entries, self.max_archive_bytes, self.max_json_values, self.max_csv_rows)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str | Path, environment: Mapping[str, str] = os.environ) -> Settings:
        """The environment before the file before the defaults."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given = json.loads(Path(path).read_text()) if Path(path).exists() else {}
        said = {name: environment[PREFIX + name.upper()] for name in kinds if PREFIX + name.upper() in environment}
        read = {n: tuple(v.split(",")) if kinds[n] is tuple else kinds[n](v) for n, v in said.items()}
        return replace(cls(), **{n: kinds[n](v) for n, v in given.items() if n in kinds} | read)


def load_questions(path: str | Path) -> Iterator[dict]:
    """Evaluation questions, one JSON object on each line: id, question, gold (keys); # begins a comment line."""
    seen = set()
    for number, line in enumerate(Path(path).read_text().splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = json.loads(line)
        fits = isinstance(item, dict) and isinstance(item.get("question"), str) and isinstance(item.get("gold"), list) and item["gold"]
        if not fits or item.get("id") in seen or "id" not in item:
            raise ValueError(f"line {number} is no question with an id of its own and gold keys")
        seen.add(item["id"])
        yield item
    if not seen:
        raise ValueError("the file holds no question")
