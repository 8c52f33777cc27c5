"""Files on the driver that only their owner may read, and the guarded removal of a store."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from kinweft.config import ConfigError


def _inside(path: Path, root: str) -> bool:
    real = Path(os.path.realpath(root))
    return path != real and path.is_relative_to(real)


def _plain_file(path: Path) -> bool:
    return path.is_file() and not path.is_symlink() and path.lstat().st_nlink == 1


def write_private(path: str, text: str, allowed_root: str | None = None, overwrite: bool = False) -> None:
    """Write a file of mode 0600 in a folder of mode 0700.

    The path must be absolute and, with ``allowed_root``, lie below it also once links are followed.  What is there
    already is only replaced with ``overwrite``, and never if it is a link, a folder or has several names.
    """
    if not os.path.isabs(path):
        raise ConfigError("OUTPUT_PATH_NOT_ABSOLUTE")
    to = Path(os.path.normpath(path))
    if allowed_root is not None:
        os.makedirs(allowed_root, mode=0o700, exist_ok=True)
        nearest = next(p for p in to.parents if p.exists())
        if not _inside(Path(os.path.realpath(nearest)) / to.relative_to(nearest), allowed_root):
            raise ConfigError("OUTPUT_OUTSIDE_ROOT")
    to.parent.mkdir(parents=True, mode=0o700, exist_ok=True)
    os.chmod(to.parent, 0o700)
    if to.is_symlink() or (to.exists() and not _plain_file(to)):
        raise ConfigError("OUTPUT_NOT_A_PLAIN_FILE")
    if to.exists() and not overwrite:
        raise ConfigError("OUTPUT_EXISTS")
    # a new file that takes the name when it is whole: nobody sees half of it, and no link is followed
    part = to.with_name(f".{to.name}.{os.getpid()}")
    with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600), "w", encoding="utf-8") as f:
        f.write(text)
    try:
        if overwrite:
            os.replace(part, to)
        else:
            os.link(part, to)
    except FileExistsError:
        raise ConfigError("OUTPUT_EXISTS") from None
    finally:
        part.unlink(missing_ok=True)


def store_problem(path: str) -> str | None:
    """Why a folder may not hold a store: relative, a root or a home, or reached by a link."""
    if not os.path.isabs(path):
        return "STORE_PATH_NOT_ABSOLUTE"
    at = Path(os.path.normpath(path))
    if len(at.parts) < 3 or at == Path.home():
        return "STORE_PATH_UNSAFE"
    return "STORE_PATH_IS_A_LINK" if at.is_symlink() or at.parent.is_symlink() else None


def reset_store(path: str, allowed_root: str) -> bool:
    """Remove a store's folder below ``allowed_root``; False if there is none.

    A folder that is not a store (no ``_log`` nor ``_manifests``) or holds any link or file of several names stays whole.
    """
    if problem := store_problem(path):
        raise ConfigError(problem)
    at = Path(os.path.normpath(path))
    if not os.path.isabs(allowed_root) or not _inside(Path(os.path.realpath(at.parent)) / at.name, allowed_root):
        raise ConfigError("RESET_OUTSIDE_ROOT")
    if not at.exists():
        return False
    if not ((at / "_log").is_dir() or (at / "_manifests").is_dir()) or any(not p.is_dir() and not _plain_file(p) or p.is_symlink() for p in at.rglob("*")):
        raise ConfigError("RESET_NOT_A_PLAIN_STORE")
    shutil.rmtree(at)
    return True
