"""The session of the other tests."""

import pytest

pytest.importorskip("scholion.llm")
