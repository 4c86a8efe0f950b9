import sys

from veridelta.cli import main

sys.exit(main())
