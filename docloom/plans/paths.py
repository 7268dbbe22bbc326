"""Field paths.  Two dialects, one form: the filter dialect of scans and the namespaced dialect of indexes."""

from __future__ import annotations

import re
from dataclasses import dataclass

CURRENT = "_current"


class PathError(ValueError):
    """The text isn't a path; conditions on it match nothing."""


class Wild:
    """The segment that stands for every member."""

    def __repr__(self) -> str:
        return "*"


ANY = Wild()


@dataclass(frozen=True)
class Path:
    segments: tuple

    @property
    def is_wild(self) -> bool:
        return any(s is ANY for s in self.segments)

    @property
    def never_matches(self) -> bool:
        """Negative positions name nothing."""
        return any(isinstance(s, int) and s < 0 for s in self.segments)

    def variant_path(self) -> str | None:
        """As `variant_get` takes it; None if the path names nothing there or can't be written."""
        if self.never_matches or self.is_wild:
            return None
        steps = self.variant_steps()
        return steps[0] if len(steps) == 1 and steps[0].startswith("$") else None

    def variant_steps(self) -> list[str]:
        """Paths as `variant_get` takes them, beginning with $, and bare keys that it can't name as they hold both quotes.

        A bare key is marked by a leading =.
        """
        out = ["$"]
        for s in self.segments:
            text = f"[{s}]" if isinstance(s, int) else f'["{s}"]' if '"' not in s else f"['{s}']" if "'" not in s else None
            if text is None:
                out += ["=" + s, "$"]
            else:
                out[-1] += text
        return [x for x in out if x != "$"] or ["$"]

    def json_path(self) -> str:
        """As `get_json_object` takes it, wildcards included; a key with a quote or question mark is written behind a dot."""
        return "$" + "".join(f"[{s}]" if isinstance(s, int) else "[*]" if s is ANY else f".{s}" if "'" in s or "?" in s else f"['{s}']" for s in self.segments)


def filter_path(text: str) -> Path:
    """Segments between dots, each with any number of [n]; leading dots and slashes don't count, nor do empty segments.

    A dollar sign is part of a key here.  A bracket that isn't closed, is empty or holds no integer is an error.
    """
    out: list = []
    for part in text.lstrip("./").split("."):
        key, rest = part.partition("[")[0], part[len(part.partition("[")[0]) :]
        if key:
            out.append(key)
        while rest:
            if not rest.startswith("["):
                raise PathError(f"text behind a bracket in {text!r}")
            inner, closed, rest = rest[1:].partition("]")
            if not closed:
                raise PathError(f"a bracket isn't closed in {text!r}")
            if not re.fullmatch(r"[+-]?\d+", inner):
                raise PathError(f"[{inner}] isn't a position in {text!r}")
            out.append(int(inner))
    return Path(tuple(out))


def normalize_path(text: str) -> str:
    """a.b -> $_current.a.b; $g.a stays; $.a -> $_current.a; the first segment is kept."""
    if text.startswith("$."):
        return f"${CURRENT}.{text[2:]}"
    if text == "$":
        return f"${CURRENT}"
    return text if text.startswith("$") else f"${CURRENT}.{text}"


def namespace_of(text: str) -> str:
    """$gene.x -> gene; _current where none is named."""
    m = re.match(r"\$([^.\[]+)", text)
    return m[1] if m else CURRENT


def local_path(text: str) -> str:
    """The normalised path without its namespace, from the document's root."""
    return re.sub(r"^\$[^.\[]*", "$", normalize_path(text))


def index_path(text: str) -> Path:
    """A path of the index dialect: dots, ['key'], [n], [*] and .* after an optional namespace."""
    rest, out = local_path(text)[1:], []
    while rest:
        m = re.match(r"""\.\*|\[\*\]|\.?\[(-?\d+)\]|\.?\[\s*'([^']*)'\s*\]|\.?\[\s*"([^"]*)"\s*\]|\.([^.\[]+)""", rest)
        if not m:
            raise PathError(f"{rest!r} isn't a path, in {text!r}")
        number, single, double, plain = m.groups()
        out.append(int(number) if number else next((x for x in (single, double, plain) if x is not None), ANY))
        rest = rest[m.end() :]
    return Path(tuple(out))
