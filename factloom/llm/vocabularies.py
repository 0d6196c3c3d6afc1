"""Where public vocabulary files are."""

from __future__ import annotations

import os


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; FACTLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("FACTLOOM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
