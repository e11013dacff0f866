import importlib.util

import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def pytest_ignore_collect(collection_path, config):
    return importlib.util.find_spec("verdigris.llm") is None
