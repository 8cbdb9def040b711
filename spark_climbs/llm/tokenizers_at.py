"""Where the vocabularies of public tokenizers are on every machine of the cluster."""

from __future__ import annotations

import os


def path(name: str, folder: str | None = None) -> str:
    """File of a vocabulary: in ``folder``, or where the ``public_tokenizers`` package has it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
