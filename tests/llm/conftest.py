import pytest

pytest.importorskip("maskwright.llm")
