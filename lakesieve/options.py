"""Option sets of folder runs with their defaults, and the presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FolderScope:
    """What a folder run does. ``keep_file`` and ``keep_line`` are patterns of markers that protect a file or a line."""

    remove_files: bool = True
    within_lines: bool = True
    within_code: bool = False
    across_lines: bool = True
    code_blocks: bool = True
    remove_blocks: bool = False
    preserve_entries: bool = True
    strategy: str = "shortest"
    ignore: tuple[str, ...] = ("node_modules", "git", "dist", "vendor")
    manual_skips: str = ""
    keep_file: str = r"dedupe:\s*keep\b"
    keep_line: str = r"dedupe:\s*keep-line\b"
    ignore_case: bool = False
    ignore_punct: bool = False
    collapse_ws: bool = False


PRESETS = {
    "safe": FolderScope(),
    "data": FolderScope(remove_files=False, code_blocks=False),
    "report": FolderScope(remove_files=False, within_lines=False, across_lines=False),
    "aggressive": FolderScope(within_code=True, remove_blocks=True),
}
