import sys

from lodestone.cli import main

sys.exit(main())
