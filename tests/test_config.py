from textquarry import config

TEXT = """project:
  name: x

# comment
paths:
  corpus_dir: 'texts'
search:
  default_top_k: 7
"""


def test_load(tmp_path):
    assert config.load(tmp_path / "none").top_k == 5
    (tmp_path / "config.yaml").write_text(TEXT)
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    s = config.load(deep)
    assert (s.root, s.corpus, s.data, s.top_k, s.max_chars) == (str(tmp_path), "texts", "data", 7, 1200)
