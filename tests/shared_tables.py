"""Where the shared test tables lie."""

SF_SMALL = "/root/testdata/sf0.001"
