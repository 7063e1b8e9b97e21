from pathlib import Path

import pytest

from panelwright.session import cut_lineage, settle, shared_folder


class Conf:
    def get(self, key, default):
        return default


class Session:
    conf = Conf()


def test_no_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        shared_folder(Session())


def test_settle_keeps_only_the_result(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = settle(lambda: cut_lineage(cut_lineage(spark.range(5)).where("id > 1")).selectExpr("id + 1 as id"))
    assert len(set(folder.iterdir()) - before) == 1
    assert sorted(r.id for r in rows.collect()) == [3, 4, 5]
    with pytest.raises(AttributeError):
        settle(lambda: cut_lineage(spark.range(1)).nothing())
    cut_lineage(spark.range(1))
    assert len(set(folder.iterdir()) - before) == 3
