"""Column functions: text, paths and attribute maps, similarity, typed signals, and the word lists they use."""
