"""Policies and vaults of a person in one folder, kept private."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from ..operators.terms import fold
from ..policy import ConfigError, Policy

GLOBAL = "_global"
KEY_VARIABLE = "VEILSPARK_VAULT_KEY"


def slugify(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", fold(name)).strip("-")[:64].strip("-") or "engagement"


def checked(name: str) -> str:
    if not re.fullmatch(r"(?!\.)[A-Za-z0-9._-]{1,64}", name):
        raise ConfigError(f"invalid name {name!r}")
    return name


def write_private(path: Path, content: bytes) -> None:
    """For the owner only, and at once: a reader sees the old content or the new."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, at = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.chmod(at, 0o600)
        os.replace(at, path)
    except BaseException:
        Path(at).unlink(missing_ok=True)
        raise


class Store:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    @classmethod
    def default(cls) -> Store:
        base = os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config"
        return cls(Path(base) / "veilspark")

    @property
    def global_path(self) -> Path:
        return self.folder / "config.toml"

    def engagement_path(self, name: str) -> Path:
        return self.folder / "engagements" / f"{checked(name)}.toml"

    def vault_path(self, profile: str) -> Path:
        return self.folder / "vaults" / f"{checked(profile)}.vault"

    def load_global(self) -> Policy:
        return Policy.load(self.global_path) if self.global_path.exists() else Policy()

    def save_global(self, policy: Policy) -> None:
        write_private(self.global_path, policy.to_toml().encode())

    def engagements(self) -> list[str]:
        return sorted(p.stem for p in (self.folder / "engagements").glob("*.toml"))

    def load_engagement(self, name: str) -> Policy:
        return Policy.load(self.engagement_path(name))

    def save_engagement(self, name: str, policy: Policy) -> None:
        write_private(self.engagement_path(name), policy.to_toml().encode())

    def create_engagement(self, display: str) -> str:
        """An empty engagement under a free name made from ``display``."""
        if not display.strip():
            raise ConfigError("the name is empty")
        slug, known = slugify(display), set(self.engagements())
        free = next(n for n in (slug, *(f"{slug[:60]}-{k}" for k in range(2, 10_000))) if n not in known)
        self.save_engagement(free, Policy(name=display.strip()))
        return free

    def delete_engagement(self, name: str) -> None:
        self.engagement_path(name).unlink(missing_ok=True)

    def find_engagement(self, query: str) -> str:
        """By id, then by display name (case and outer blanks aside), then by slug."""
        known, low = self.engagements(), query.strip().lower()
        if query in known:
            return query
        for name in known:
            if (self.load_engagement(name).name or "").strip().lower() == low:
                return name
        if slugify(query) in known:
            return slugify(query)
        raise ConfigError(f"no engagement {query!r}")

    def resolve(self, engagement: str | None) -> Policy:
        base = self.load_global()
        return base if engagement is None else base.layered(self.load_engagement(self.find_engagement(engagement)))

    def profile(self, engagement: str | None) -> str:
        """The vault an engagement (or the path of a policy) uses."""
        if engagement is None:
            return GLOBAL
        return slugify(Path(engagement).stem) if Path(engagement).exists() else self.find_engagement(engagement)

    def load_vault(self, profile: str) -> bytes | None:
        path = self.vault_path(profile)
        return path.read_bytes() if path.exists() else None

    def save_vault(self, profile: str, sealed: bytes) -> None:
        write_private(self.vault_path(profile), sealed)

    def delete_vault(self, profile: str) -> None:
        self.vault_path(profile).unlink(missing_ok=True)
