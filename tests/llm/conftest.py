import sys
from pathlib import Path

if (here := str(Path(__file__).resolve().parent)) not in sys.path:
    sys.path.insert(0, here)
