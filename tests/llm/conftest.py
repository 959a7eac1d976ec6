import pytest

from tidemark.llm import look


@pytest.fixture(autouse=True)
def letter_shapes(spark):
    look.use(look.letter_shapes(spark))
