"""Settings: a JSON document in which every key has a default; partial updates."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pathlake.operators.exclusions import ExcludeNames, effective_roots
from pathlake.schema import CACHE_MAX, EXCLUDED_FSTYPES, TEXT_MAX
from pathlake.sources.walk import WalkOptions


@dataclass
class Config:
    roots: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=list)
    exclude_names_file: str | None = None
    extra_excluded_fstypes: list[str] = field(default_factory=list)
    exclude_network: bool = True
    exclude_removable: bool = True
    respect_ignore_files: bool = True
    follow_symlinks: bool = False
    index_hidden_dirs: bool = False
    persist_index: bool = True
    content_index: bool = False
    candidate_cap: int | None = None
    content_max_file_bytes: int = TEXT_MAX
    content_max_total_bytes: int = CACHE_MAX
    overlay_compaction_threshold: int = 8192
    rescan_interval_secs: int = 30
    max_results: int | None = None
    paused: bool = False

    @classmethod
    def load(cls, path: str) -> Config:
        """Missing or damaged documents give the defaults; unknown keys and values of a wrong type are ignored."""
        try:
            data = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            data = None
        return (cls().patched(data) if isinstance(data, dict) else cls()).overridden(os.environ)

    def overridden(self, env) -> Config:
        """With what the environment says of a switch: PATHLAKE_ and its name, as 1, true, yes, on or 0, false, no, off. Other values say nothing."""
        said = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        switches = [f.name for f in fields(self) if isinstance(getattr(Config(), f.name), bool)]
        found = {k: said.get((env.get(f"PATHLAKE_{k.upper()}") or "").strip().lower()) for k in switches}
        return self.patched({k: v for k, v in found.items() if v is not None})

    def patched(self, patch: dict) -> Config:
        known, plain = {f.name for f in fields(self)}, asdict(Config())
        good = {k: v for k, v in patch.items() if k in known and (plain[k] is None or isinstance(v, type(plain[k])) and isinstance(v, bool) == isinstance(plain[k], bool))}
        return Config(**{**asdict(self), **good})

    def save(self, path: str) -> None:
        """Written beside and renamed, so that a reader never sees half of it."""
        part = f"{path}.part"
        Path(part).write_text(json.dumps(asdict(self), indent=2))
        os.replace(part, path)

    def walk_options(self, home: str = "~") -> WalkOptions:
        home = os.path.expanduser(home)
        names = None
        if self.exclude_names_file:
            try:
                names = Path(self.exclude_names_file).read_text()
            except OSError:
                names = None
        return WalkOptions(effective_roots([expand(r, home) for r in self.roots], home), self.respect_ignore_files, self.follow_symlinks, self.index_hidden_dirs, names, list(dict.fromkeys(expand(d, home) for d in self.exclude_dirs)))

    def fstypes(self) -> list[str]:
        return list(dict.fromkeys([*EXCLUDED_FSTYPES, *self.extra_excluded_fstypes]))


def expand(path: str, home: str) -> str:
    """`~`, and paths relative to the home directory; without links, dots and double slashes. What isn't there stays as it is named."""
    if path == "~" or path.startswith("~/"):
        path = home + path[1:]
    full = path if path.startswith("/") else f"{home}/{path}"
    return os.path.realpath(full) if os.path.exists(full) else full


__all__ = ["Config", "ExcludeNames", "expand"]
