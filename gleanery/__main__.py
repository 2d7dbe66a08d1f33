from gleanery.cli import main

raise SystemExit(main())
