"""What several test modules of this folder share."""

SF001 = "/root/testdata/sf0.001"
