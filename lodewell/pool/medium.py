"""What a refusing medium means for a run: which device is stopped, what is told, what its names are."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

ALLOWED = 8


@dataclass(frozen=True)
class Incident:
    member: int
    offset: int
    length: int
    errno: int
    ts: int
    stopped: bool

    def text(self) -> str:
        then = "the run ends here; image the device and go on from the image" if self.stopped else "the bytes count as lost"
        return f"device {self.member} refused {self.length} bytes at {self.offset} ({os.strerror(self.errno) if self.errno else 'no error code'}): {then}"

    def as_json(self) -> dict[str, Any]:
        return {"member": self.member, "offset": self.offset, "lba": self.offset // 512, "length": self.length, "errno": self.errno, "ts": self.ts, "stopped": self.stopped}


class Stopped(OSError):
    """A device refused and must not be read again."""


@dataclass
class Ledger:
    """The first refused read of a device stops the run; with ``may_fail`` the ninth does. A stopped device is never read again."""

    may_fail: bool = False
    clock: Callable[[], float] = time.time
    incidents: list[Incident] = field(default_factory=list)
    stopped: set[int] = field(default_factory=set)

    def check(self, member: int) -> None:
        if member in self.stopped:
            raise Stopped(f"device {member} was stopped")

    def refused(self, member: int, offset: int, length: int, errno: int = 5) -> Incident:
        count = sum(i.member == member for i in self.incidents) + 1
        stop = not self.may_fail or count > ALLOWED
        found = Incident(member, offset, length, errno, int(self.clock()), stop)
        self.incidents.append(found)
        if stop:
            self.stopped.add(member)
            raise Stopped(found.text())
        return found


def beneath(device: str, sys_block: str = "/sys/class/block", depth: int = 8) -> list[str]:
    """The devices that a block device stands on: its disk, what it is stacked on, a loop device's file."""
    out: list[str] = []
    todo = [(os.path.basename(os.path.realpath(device)), 0)]
    while todo:
        name, level = todo.pop()
        at = os.path.join(sys_block, name)
        if level >= depth or not os.path.exists(at):
            continue
        slaves = os.path.join(at, "slaves")
        under = os.listdir(slaves) if os.path.isdir(slaves) else []
        if os.path.exists(os.path.join(at, "partition")):
            under.append(os.path.basename(os.path.dirname(os.path.realpath(at))))
        loop = os.path.join(at, "loop", "backing_file")
        if os.path.exists(loop):
            with open(loop) as f:
                out.append(f.read().strip())
        for u in sorted(under):
            if u not in out:
                out.append(u)
                todo.append((u, level + 1))
    return out
