import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import documents, none, odd, odd_rows, texts  # noqa: E402, F401
