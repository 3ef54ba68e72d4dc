"""Stock steps that bring files into the vault or reshape what is there."""
