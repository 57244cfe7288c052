"""What the driver's machine tells: devices, remotes, free space, tools, and where a catalogue lies."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExternalToolError, FileMissing


@dataclass
class Device:
    mount_path: str | None = None
    device_path: str | None = None
    device_id: str | None = None
    uuid: str | None = None
    fs_type: str | None = None
    total_bytes: int | None = None
    model: str | None = None
    serial: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(self).values())], ", ".join(f"{k} {'long' if k == 'total_bytes' else 'string'}" for k in vars(self)))


def _said(*command: str) -> str | None:
    """What a tool prints; null if it isn't there or fails."""
    if not shutil.which(command[0]):
        return None
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else None


def device_size(text: str) -> int | None:
    """Bytes of 1.5G, 100M, 512; null if it is no size."""
    number, factor = text.strip(), 1
    if number[-1:].upper() in tuple("KMGT"):
        number, factor = number[:-1], 1024 ** ("KMGT".index(number[-1].upper()) + 1)
    try:
        return int(float(number) * factor)
    except ValueError:
        return None


def discover_device(mount: str) -> Device:
    """The device that is mounted there, as far as findmnt, blkid, lsblk and /dev/disk/by-id know it."""
    found = Device(mount_path=mount)
    words = (_said("findmnt", "-n", "-o", "SOURCE,FSTYPE", mount) or "").split()
    if len(words) >= 2:
        found.device_path, found.fs_type = words[:2]
    if found.device_path:
        found.uuid = _said("blkid", "-s", "UUID", "-o", "value", found.device_path) or None
        words = (_said("lsblk", "-n", "-o", "SIZE,MODEL,SERIAL", found.device_path) or "").split()
        found.total_bytes = device_size(words[0]) if words else None
        found.model, found.serial = [*words[1:3], None, None][:2]
        by_id, name = Path("/dev/disk/by-id"), os.path.basename(found.device_path)
        if by_id.is_dir():
            found.device_id = next((x.name for x in sorted(by_id.iterdir()) if x.is_symlink() and os.path.basename(os.readlink(x)) == name), None)
    return found


def discover_remote(remote: str) -> Device:
    """A remote's capacity."""
    out = run_tool("rclone", "about", f"{remote}:", "--json")
    return Device(device_path=f"{remote}:", fs_type="rclone", total_bytes=json.loads(out).get("total"))


def remote_free(remote: str) -> int | None:
    """A remote's free bytes, null if it doesn't tell."""
    return json.loads(run_tool("rclone", "about", f"{remote}:", "--json")).get("free")


@dataclass
class Space:
    total_bytes: int
    free_bytes: int
    available_bytes: int

    def max_safe_write_bytes(self, part: float = 0.5) -> int:
        return min(int(self.free_bytes * part), self.available_bytes)

    def can_safely_write(self, need: int) -> bool:
        return need <= self.max_safe_write_bytes()


def free_space(path: str) -> Space:
    try:
        x = os.statvfs(path)
    except OSError as e:
        raise FileMissing(path) from e
    return Space(x.f_blocks * x.f_frsize, x.f_bfree * x.f_frsize, x.f_bavail * x.f_frsize)


def has_tool(name: str) -> bool:
    return shutil.which(name) is not None


def run_tool(*command: str) -> str:
    """What the tool prints; it must be there and succeed."""
    if not has_tool(command[0]):
        raise ExternalToolError(f"{command[0]} is not installed")
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise ExternalToolError(f"{command[0]} failed: {done.stderr.strip()}")
    return done.stdout


def list_remotes() -> list[str]:
    return [x.strip().rstrip(":") for x in run_tool("rclone", "listremotes").splitlines() if x.strip()]


def catalogue_path(given: str | None = None, env: str = "STRATAFILE_CATALOGUE") -> str:
    """Where the catalogue lies: as given, as the environment says, or below the user's data folder."""
    if given or os.environ.get(env):
        return given or os.environ[env]
    base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "stratafile", "catalogue")
