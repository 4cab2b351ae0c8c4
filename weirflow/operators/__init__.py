from weirflow.operators.aggregate import fold, fold_with, summarize
from weirflow.operators.group import cogroup, cogroup_stream, cogroup_with, group_sort, group_sort_with, group_stream
from weirflow.operators.join import Selection, master_branch, master_check, master_join, master_join_update
from weirflow.operators.record import branch, convert, extend, extract, extract_with, keep, logging_op, project, restructure, split, update, update_with
from weirflow.operators.sets import checkpoint, confluent, duplicate, empty, one_pass, stop
from weirflow.operators.views import View, view

__all__ = [
    "Selection", "View", "branch", "checkpoint", "cogroup", "cogroup_stream", "cogroup_with", "confluent", "convert", "duplicate", "empty", "extend", "extract", "extract_with",
    "fold", "fold_with", "group_sort", "group_sort_with", "group_stream", "keep", "logging_op", "master_branch", "master_check", "master_join", "master_join_update",
    "one_pass", "project", "restructure", "split", "stop", "summarize", "update", "update_with", "view",
]
