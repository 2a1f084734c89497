"""Ignore files: the last rule that matches a path decides; deeper files win over those above them."""

from __future__ import annotations

import re
from dataclasses import dataclass

IGNORE_FILES = (".gitignore", ".ignore")  # later ones win


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    dirs_only: bool


def _body(glob: str) -> str:
    """A gitignore glob as a regular expression: "*" and "?" stop at slashes, "**" doesn't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob[i] == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            inner = ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\")
            out, i = out + f"[{inner}]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse(text: str) -> list[Rule]:
    rules = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        dirs_only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _body(line.lstrip("/"))
        try:
            rules.append(Rule(re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}$", re.S), negated, dirs_only))
        except re.error:
            continue
    return rules


def verdict(rules: list[Rule], relative: str, is_dir: bool) -> bool | None:
    """True: ignored, False: kept by a negation, None: no rule says anything."""
    for r in reversed(rules):
        if (is_dir or not r.dirs_only) and r.pattern.match(relative):
            return not r.negated
    return None


class Ignore:
    """The rules that hold in a directory: its own files' and those of the directories above, the nearest first."""

    def __init__(self, levels: tuple[tuple[str, tuple[Rule, ...]], ...] = ()):
        self.levels = levels

    def enter(self, directory: str, texts: list[str]) -> Ignore:
        rules = tuple(r for t in texts for r in parse(t))
        return Ignore((*self.levels, (directory.rstrip("/"), rules))) if rules else self

    def ignores(self, path: str, is_dir: bool) -> bool:
        for base, rules in reversed(self.levels):
            if path.startswith(base + "/"):
                said = verdict(list(rules), path[len(base) + 1 :], is_dir)
                if said is not None:
                    return said
        return False
