"""What to mask and how: configuration, its layers, and its TOML form."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

LISTS = ("client", "users", "hosts", "allow_domains", "sensitive_headers", "sensitive_keys")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Masking:
    """Shares: of an identifier that is hidden, of a secret and of a name that stay."""

    id_cut: float = 0.2
    secret_keep: float = 0.3
    pii_keep: float = 0.4

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if not isinstance(v, int | float) or isinstance(v, bool) or not 0 <= v <= 1:
                raise ConfigError(f"masking.{f.name} must be between 0 and 1")


@dataclass(frozen=True)
class Term:
    value: str
    replacement: str | None = None


@dataclass(frozen=True)
class Policy:
    name: str | None = None
    client: tuple[str, ...] = ()
    users: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    terms: tuple[Term, ...] = ()
    allow_domains: tuple[str, ...] = ()
    sensitive_headers: tuple[str, ...] = ()
    sensitive_keys: tuple[str, ...] = ()
    masking: Masking | None = field(default=None)

    @property
    def ratios(self) -> Masking:
        return self.masking or Masking()

    def layered(self, top: Policy) -> Policy:
        """This policy with another on top: lists add up, name and masking are the upper ones if given.

        Masking is taken as a whole: fields the upper layer leaves out are the
        defaults, not this policy's.
        """
        lists = {n: getattr(self, n) + getattr(top, n) for n in (*LISTS, "terms")}
        return replace(self, **lists, name=top.name or self.name, masking=top.masking or self.masking)

    @classmethod
    def from_toml(cls, source: str) -> Policy:
        try:
            raw = tomllib.loads(source)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e
        _known(raw, {f.name for f in fields(cls)}, "")
        out = {}
        for key, value in raw.items():
            if key in LISTS:
                if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                    raise ConfigError(f"{key} must be a list of strings")
                out[key] = tuple(value)
            elif key == "terms":
                for t in value:
                    _known(t, {"value", "replacement"}, "terms.")
                    if not isinstance(t.get("value"), str):
                        raise ConfigError("terms.value is missing")
                out[key] = tuple(Term(t["value"], t.get("replacement")) for t in value)
            elif key == "masking":
                _known(value, {f.name for f in fields(Masking)}, "masking.")
                out[key] = Masking(**value)
            elif not isinstance(value, str):
                raise ConfigError("name must be a string")
            else:
                out[key] = value
        return cls(**out)

    @classmethod
    def load(cls, path: str | Path) -> Policy:
        try:
            return cls.from_toml(Path(path).read_text("utf-8"))
        except OSError as e:
            raise ConfigError(f"{path}: {e}") from e

    def to_toml(self) -> str:
        """Empty lists and what isn't set are left out."""
        lines = [f"name = {_quoted(self.name)}"] if self.name else []
        lines += [f"{n} = [{', '.join(map(_quoted, getattr(self, n)))}]" for n in LISTS if getattr(self, n)]
        for t in self.terms:
            lines += ["", "[[terms]]", f"value = {_quoted(t.value)}"] + ([f"replacement = {_quoted(t.replacement)}"] if t.replacement is not None else [])
        if self.masking:
            lines += ["", "[masking]", *(f"{f.name} = {float(getattr(self.masking, f.name))}" for f in fields(Masking))]
        return "\n".join(lines) + "\n"


def _known(raw: dict, allowed: set[str], where: str) -> None:
    if extra := sorted(set(raw) - allowed):
        raise ConfigError(f"unknown field {where}{extra[0]}")


def _quoted(x: str) -> str:
    escaped = "".join({"\\": "\\\\", '"': '\\"'}.get(c, c if c >= " " and c != "\x7f" else f"\\u{ord(c):04X}") for c in x)
    return f'"{escaped}"'
