import pytest

pytest.importorskip("lorekiln.llm")
