"""Site files as a stream: the site-wise part of a run, which needs no other site."""
