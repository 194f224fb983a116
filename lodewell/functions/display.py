"""Text for people and shells: quoting, dumps, device numbers, rebased paths."""

from __future__ import annotations

import base64
import os
import shlex


def shell_quote(text: str) -> str:
    return shlex.quote(text)


def command_line(argv: list[str]) -> str:
    return " ".join(map(shlex.quote, argv))


def hexdump(data: bytes, base: int = 0, most: int = 256) -> str:
    """Sixteen bytes a row with offsets and printable characters; what is beyond ``most`` is counted."""
    rows = []
    for at in range(0, min(len(data), most), 16):
        part = data[at : at + 16]
        rows.append(f"{base + at:08x}  {part.hex(' '):<47}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}")
    if len(data) > most:
        rows.append(f"... {len(data) - most} more bytes")
    return "\n".join(rows)


def device_number(raw: int, system: str = "linux") -> tuple[int, int]:
    """(major, minor) as the system that wrote it packs them."""
    if system == "linux":
        return (raw >> 8 & 0xFFF) | (raw >> 32 & ~0xFFF & 0xFFFFFFFF), (raw & 0xFF) | (raw >> 12 & 0xFFFFFF00)
    if system == "freebsd":
        return raw >> 8 & 0xFF, (raw & 0xFFFF00FF) if raw < 1 << 32 else raw & 0xFFFFFFFF
    return raw >> 32, raw & 0xFFFFFFFF


def path_text(path: bytes) -> tuple[str, str | None]:
    """A path as text, and as hexadecimal digits where the text loses something."""
    try:
        return path.decode(), None
    except UnicodeDecodeError:
        return path.decode("utf-8", "replace"), path.hex()


def rebase(recorded: list[str], root: str) -> dict[str, str | None]:
    """Where recorded files lie below a new root: by the longest tail of the path that exists; null if that leaves several."""
    out: dict[str, str | None] = {}
    names = [os.path.basename(p) for p in recorded]
    for path, name in zip(recorded, names, strict=True):
        parts = [p for p in path.split("/") if p]
        tails = ("/".join(parts[i:]) for i in range(len(parts)))
        found = next((t for t in tails if os.path.exists(os.path.join(root, t))), None)
        # A bare name that several recorded files share says nothing about which of them it is.
        out[path] = None if found is None or (found == name and names.count(name) > 1) else os.path.join(root, found)
    return out


def b64_encode(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def b64_decode(text: str) -> bytes:
    return base64.b64decode(text, validate=True)


def from_hex(text: str) -> bytes:
    """Whole bytes only, in either case."""
    if len(text) % 2:
        raise ValueError("an odd number of hexadecimal digits")
    return bytes.fromhex(text)


def disk_names(path: str, partitions: list[str], label: str | None = None) -> list[str]:
    """The names under which a pool may have recorded a device: its own, its partitions' and its provider's label."""
    name = os.path.basename(path)
    out = [path, name, f"/dev/{name}"]
    for p in partitions:
        out += [p, f"/dev/disk/by-partlabel/{p}", f"/dev/gpt/{p}"]
    if label:
        out += [label, f"/dev/label/{label}"]
    return list(dict.fromkeys(out))
