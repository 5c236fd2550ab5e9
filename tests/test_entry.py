"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["corpus", "input_lines", "input_tokens", "output_lines", "output_tokens"] and df.count() == 6


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_no_folder_of_one_machine_on_a_cluster():
    import pytest

    from lexloom import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        _jsc = type("S", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(type("Session", (), {"sparkContext": Context(), "conf": Conf()})())
