import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from llm_fixtures import hostile, labels, nothing  # noqa: E402, F401
