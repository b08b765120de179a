"""Column functions on alleles, genotypes and text."""
