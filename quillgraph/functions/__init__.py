"""quillgraph.functions"""
