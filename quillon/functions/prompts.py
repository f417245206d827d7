"""Prompt texts from files, on the driver: comments, conditional parts and wrappers (STR-9, NDG-15)."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence


def strip_comments(text: str) -> str:
    """Without a byte order mark, HTML comments and lines that are comments; line ends become one character."""
    plain = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"(?m)^[ \t]*//.*(?:\n|$)", "", re.sub(r"(?s)<!--.*?-->", "", plain))


def strip_part(text: str, tag: str) -> str:
    """Without the parts between a tag and its end."""
    return re.sub(rf"(?is)<{re.escape(tag)}>.*?</{re.escape(tag)}>", "", text)


def unwrapped(text: str, tag: str) -> str:
    """The text inside a wrapper around all of it; a text without wrapper as it is; one that is wrapped at one end alone is rejected, as empty."""
    text = text.strip()
    opening, closing = re.match(rf"(?i)<{re.escape(tag)}\b[^>]*>\s*", text), re.search(rf"(?i)\s*</{re.escape(tag)}>\Z", text)
    if (opening is None) != (closing is None):
        return ""
    return text if opening is None else text[opening.end() : closing.start()].strip()


def editable(text: str, tag: str, conditional: Sequence[str] = ()) -> str:
    """What of a file counts as the prompt."""
    text = strip_comments(text)
    for name in conditional:
        text = strip_part(text, name)
    return unwrapped(text, tag)


def wrapped(text: str, tag: str) -> str:
    """A prompt between its tags, once; empty stays empty."""
    return f"<{tag}>\n{text.strip()}\n</{tag}>" if text.strip() else ""


def load(name: str, default: str, folders: Sequence[str], tag: str, conditional: Sequence[str] = ()) -> str:
    """The prompt of the last folder that has a file ``name``.md with a usable text, else the default; wrapped once."""
    for folder in reversed(folders):
        path = os.path.join(folder, f"{name}.md")
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                if text := editable(f.read(), tag, conditional):
                    return wrapped(text, tag)
    return wrapped(editable(default, tag, conditional), tag)
