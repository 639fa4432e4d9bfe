import pytest

pytest.importorskip("engramlake.llm.queries")
