"""The preparation job and the four scenarios, built from the operators."""
