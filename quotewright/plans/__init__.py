"""The views a quotation desk works with and the batch changes it makes."""
