import pytest

pytest.importorskip("sunledger.llm.registry")
