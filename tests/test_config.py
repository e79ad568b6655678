import pytest

from quillmark.config import ConfigError, Root, Settings, parse_roots, root_of_path


def test_roots(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    assert [r.label for r in parse_roots(f"notes={tmp_path}/a:memory={tmp_path}/b")] == ["notes", "memory"]


@pytest.mark.parametrize(
    ("spec", "says"),
    [
        (None, "not set"), ("", "empty"), ("notes", "no '='"), ("=/tmp", "empty"), ("notes=/tmp:", "empty"), ("notes=/tmp:x=", "empty path"),
        ("a=/tmp:a=/tmp", "twice"), ("notes=/no/such/dir", "cannot be resolved"), ("notes=/tmp:/x", "no '='"), ("bad=/no/such:", "empty"),
    ],
)
def test_bad_roots(spec, says):
    with pytest.raises(ConfigError, match=says):
        parse_roots(spec)


def test_a_file_is_no_root(tmp_path):
    (tmp_path / "f").write_text("")
    with pytest.raises(ConfigError, match="not a directory"):
        parse_roots(f"x={tmp_path}/f")


def test_first_root_wins_by_whole_components(tmp_path):
    outer, inner = Root("outer", str(tmp_path)), Root("inner", str(tmp_path / "in"))
    assert root_of_path([outer, inner], str(tmp_path / "in/x.md")).label == "outer"
    assert root_of_path([inner, outer], str(tmp_path / "in/x.md")).label == "inner"
    assert root_of_path([inner], str(tmp_path / "inside/x.md")) is None


def test_settings(tmp_path):
    s = Settings.from_env({"QUILLMARK_ROOTS": f"n={tmp_path}", "QUILLMARK_STATE_DIR": "/s"})
    assert s.warehouse == "/s/warehouse" and s.model_dir is None
