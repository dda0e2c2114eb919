"""Configuration: profiles in YAML, paths, the merge of global and local settings."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

try:  # profiles may be given as dictionaries where there is no YAML
    import yaml
except ImportError:
    yaml = None

LOCAL_NAME = ".config.yaml"


class ConfigError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = (".",)
    exclude: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


def from_dict(settings: dict) -> Config:
    lists = ("include", "exclude", "blacklist", "whitelist")
    known = {k: tuple(settings.get(k) or ()) for k in lists if k in settings}
    return Config(**known, options={k: v for k, v in settings.items() if k not in lists})


def load_global(path: str) -> Config:
    """The active profile of a file; an error if it has none of that name."""
    settings = _read(path)
    active, profiles = settings.get("active_profile", "default"), settings.get("profiles") or {}
    if active not in profiles:
        raise ConfigError(f"there is no profile {active!r}")
    return from_dict(profiles[active] or {})


def load_local(path: str) -> Config:
    return replace(from_dict({"include": (), **_read(path)}))


def _read(path: str) -> dict:
    if yaml is None:
        raise ConfigError("reading YAML needs the yaml package")
    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e


def normalize(path: str) -> str:
    return os.path.abspath(os.path.expanduser(path))


def resolve(path: str, base: str) -> str:
    """An absolute, clean path; `~/` is the home folder, others are relative to base."""
    path = os.path.expanduser(path)
    return os.path.normpath(path if os.path.isabs(path) else os.path.join(base, path))


def resolve_all(paths, base: str) -> list[str]:
    return [resolve(p, base) for p in paths]


def contains(folder: str, path: str) -> bool:
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def check_inside(path: str, base: str) -> str:
    """The resolved path, which must lie in base."""
    found = resolve(path, base)
    if not contains(os.path.normpath(base), found):
        raise ConfigError(f"{path} leads out of {base}")
    return found


def check_includes(paths, allowed) -> None:
    """Every path must lie in an allowed folder."""
    for path in paths:
        if not any(contains(os.path.normpath(a), path) for a in allowed):
            raise ConfigError(f"{path} is in none of the included folders")


def merge_for_daemon(shared: Config, local: Config | None, base: str) -> Config:
    """Local settings add exclusions and blacklist patterns, and nothing else."""
    if local is None:
        return shared
    return replace(shared, exclude=(*shared.exclude, *resolve_all(local.exclude, base)), blacklist=(*shared.blacklist, *local.blacklist))


def merge_for_cli(shared: Config, local: Config | None, base: str) -> Config:
    """As for the daemon, and included folders if they lie in the shared ones."""
    if local is None:
        return shared
    includes = resolve_all(local.include, base)
    check_includes(includes, resolve_all(shared.include, base))
    return replace(merge_for_daemon(shared, local, base), include=(*shared.include, *includes))


def find_local(start: str) -> str | None:
    """The nearest local settings at or above a folder."""
    folder = normalize(start)
    while True:
        candidate = os.path.join(folder, LOCAL_NAME)
        if os.path.isfile(candidate):
            return candidate
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def config_for_file(shared: Config, path: str, daemon: bool = True) -> Config:
    found = find_local(os.path.dirname(normalize(path)))
    if found is None:
        return shared
    merge = merge_for_daemon if daemon else merge_for_cli
    return merge(shared, load_local(found), os.path.dirname(found))


class ConfigCache:
    """Merged settings by their local file and purpose, read again once that file changes."""

    def __init__(self, shared: Config):
        self.shared, self._held, self._lock = shared, {}, threading.Lock()
        self._listeners: list[Callable[[str, str], None]] = []

    def listen(self, listener: Callable[[str, str], None]) -> None:
        """listener(path, event): modified, created or deleted; a rename deletes."""
        self._listeners.append(listener)

    def get(self, path: str, daemon: bool = True) -> Config:
        found = find_local(os.path.dirname(normalize(path)))
        stamp = os.stat(found).st_mtime_ns if found else 0
        with self._lock:
            held = self._held.get((found, daemon))
            if held is None or held[0] != stamp:
                held = (stamp, config_for_file(self.shared, path, daemon))
                self._held[found, daemon] = held
            return held[1]

    def poll(self) -> None:
        """Drops what has changed and tells the listeners."""
        with self._lock:
            keys = [k for k in self._held if k[0]]
            gone = [(k, os.path.isfile(k[0])) for k in keys if not os.path.isfile(k[0]) or os.stat(k[0]).st_mtime_ns != self._held[k][0]]
            for k, _ in gone:
                del self._held[k]
        for path, there in {(k[0], there) for k, there in gone}:
            for listener in self._listeners:
                listener(path, "modified" if there else "deleted")

    def tell(self, path: str, event: str) -> None:
        """Drops what may depend on a local file and tells the listeners."""
        self.clear()
        for listener in self._listeners:
            listener(path, event)

    def clear(self) -> None:
        with self._lock:
            self._held.clear()


class ConfigWatcher:
    """Looks for local settings under some folders, again and again, on a thread of its
    own, and tells the cache of those that come, change or go; a renamed one is gone."""

    def __init__(self, cache: ConfigCache, folders, poll: float = 1.0):
        self.cache, self.folders, self.poll = cache, [normalize(f) for f in folders], poll
        self._stop, self._seen = threading.Event(), self._stamps()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _stamps(self) -> dict[str, tuple[int, int]]:
        found = {}
        for top in self.folders:
            for folder, _, names in os.walk(top):
                if LOCAL_NAME in names:
                    path = os.path.join(folder, LOCAL_NAME)
                    try:
                        stat = os.stat(path)
                    except OSError:
                        continue
                    found[path] = (stat.st_mtime_ns, stat.st_size)
        return found

    def look(self) -> None:
        """One look; what has happened since the last one is told."""
        now, before = self._stamps(), self._seen
        self._seen = now
        for path in sorted(now.keys() | before.keys()):
            if now.get(path) != before.get(path):
                self.cache.tell(path, "deleted" if path not in now else "modified" if path in before else "created")

    def _run(self) -> None:
        while not self._stop.wait(self.poll):
            self.look()

    def start(self) -> ConfigWatcher:
        self._thread.start()
        return self

    def close(self) -> None:
        """Looks no more; a second call does no harm."""
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()

    def __enter__(self) -> ConfigWatcher:
        return self.start()

    def __exit__(self, *error) -> None:
        self.close()
