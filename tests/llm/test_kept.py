import pytest

from spark_climbs.llm import simhash, suffix_dedup
from spark_climbs.llm.kept import kept, release


@pytest.mark.parametrize(
    "task", [simhash._fingerprint_rows, simhash._linked, lambda b: suffix_dedup._anchor_rows(b, suffix_dedup.LONG), lambda b: suffix_dedup._cut_rows(b, suffix_dedup.LONG)]
)
def test_tasks_let_go_of_what_other_operators_kept(task):
    made = []
    kept("cache", lambda: made.append(1) or "old")
    list(task(iter([])))
    kept("cache", lambda: made.append(1) or "new")
    assert len(made) == 2 and kept("cache", lambda: "newer") == "new"
    release()
