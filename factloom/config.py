"""Engine settings, read from a TOML file; any failure to read it gives the defaults."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass
from pathlib import Path

FOLDER = ".factloom"


@dataclass(frozen=True)
class EngineConfig:
    #: Least raw cosine of a dense hit, inclusive.
    min_similarity: float = 0.15
    #: Weight of the sampled utility in the dense order.
    utility_lambda: float = 0.2
    bll_enabled: bool = True
    bll_weights_path: str = ""
    #: Neighbours on each side of a fact that belong to its context.
    context_window_size: int = 2
    #: Results of a search that asks for no number.
    search_limit: int = 5


def load(path: str | Path) -> EngineConfig:
    """Settings of the `[search]` table; unknown keys are ignored."""
    try:
        found = tomllib.loads(Path(path).read_text()).get("search", {})
        kinds = {f.name: type(f.default) for f in dataclasses.fields(EngineConfig)}
        return EngineConfig(**{k: kinds[k](v) for k, v in found.items() if k in kinds})
    except (OSError, ValueError, TypeError, AttributeError):
        return EngineConfig()


def create_default_if_missing(path: str | Path) -> bool:
    """Writes the defaults where there is no file; tells whether it did."""
    path = Path(path)
    if path.exists():
        return False
    said = {True: "true", False: "false"}
    lines = [f"{k} = {said[v] if isinstance(v, bool) else repr(v) if not isinstance(v, str) else chr(34) + v + chr(34)}" for k, v in dataclasses.asdict(EngineConfig()).items()]
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(["[search]", *lines, ""]))
    except OSError:
        return False
    return True
