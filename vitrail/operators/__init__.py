"""DataFrame operators over captures: trees, boxes, words, pictures, catalogue and scores."""
