"""Routines on single addresses and robots files that the column functions call in batches."""

from __future__ import annotations

import re


def join(base: str, href: str) -> str | None:
    """An address relative to `base`; null for fragments, other schemes and paths above the root."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    scheme, _, rest = base.partition("://")
    host, slash, path = rest.partition("/")
    path = slash + path.partition("?")[0]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) and not re.match(r"https?://", href):
        return None
    if href.startswith("//"):
        return f"{scheme}:{href}"
    if re.match(r"https?://", href):
        return href
    p, mark, query = href.partition("?")
    full = p if p.startswith("/") else (path[: path.rfind("/") + 1] or "/") + p
    out: list[str] = []
    for seg in full.split("/"):
        if seg == "..":
            if not out:
                return None
            out.pop()
        elif seg not in ("", "."):
            out.append(seg)
    end = "/" if full.endswith("/") and out else ""
    return f"{scheme}://{host}/{'/'.join(out)}{end}{mark}{query}"


def rules_for(body: str, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the group of a robots file that names the agent, else of the one for all."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    for raw in body.splitlines():
        key, colon, value = raw.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            groups[-1][1].append((key == "allow", value))
    for want in (agent.lower(), "*"):
        for names, rules in groups:
            if want in names:
                return rules
    return []


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
