"""Column-expression helpers, moment corrections, exact quantiles and the
probability finalisers (normal, t, chi-square, Shapiro-Wilk)."""
