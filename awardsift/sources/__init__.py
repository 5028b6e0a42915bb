"""Readers."""

from .dumps import archive_members, dump_files, list_archives, parse_dump_names, read_zipped_csv, rejected_archives, select_dumps
from .files import latest_snapshot, read_awards, read_csv_awards, read_json_awards, read_labeled, read_paged, rejected_awards, rejected_json, sampled

__all__ = [
    "archive_members", "dump_files", "latest_snapshot", "list_archives", "parse_dump_names", "read_awards", "read_csv_awards",
    "read_json_awards", "read_labeled", "read_paged", "read_zipped_csv", "rejected_archives", "rejected_awards",
    "rejected_json", "sampled", "select_dumps",
]
