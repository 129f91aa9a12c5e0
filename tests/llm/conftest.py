import pytest

pytest.importorskip("castweave.llm.contract")
